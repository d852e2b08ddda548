"""Snapshot screening and corpus preparation on PySpark."""
