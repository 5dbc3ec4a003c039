"""Scalar functions and type maps."""
