"""Data-parallel patterns as PySpark DataFrame functions."""
