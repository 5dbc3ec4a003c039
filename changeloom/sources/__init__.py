"""Sources of change records. A source is found by name in `registry`."""
