"""Readers of routing feeds and dimension tables, and table sinks."""
