"""Structured Streaming refresh of the daily marts from arriving fact files."""
