"""Readers and writers for listings, catalog tables, logs and metric text."""
