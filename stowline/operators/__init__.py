"""Table-to-table operators over the file catalog."""
