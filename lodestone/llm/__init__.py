"""Operators for large training-data pipelines, one module for each, and their queries."""
