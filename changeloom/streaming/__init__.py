"""Targets on plain Parquet, the streaming normaliser, and control of a running job."""
