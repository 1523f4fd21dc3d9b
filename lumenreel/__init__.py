"""A PySpark engine for searching and indexing media libraries."""
