"""Operators over change logs, targets, snapshots and position sets. Each takes and returns DataFrames."""
