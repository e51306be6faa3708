"""Reusable DataFrame building blocks for operations Spark has no single operator for."""
