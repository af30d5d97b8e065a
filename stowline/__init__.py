"""File inventory, deduplication and placement analytics as PySpark jobs."""
