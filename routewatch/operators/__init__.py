"""Reusable DataFrame operators: prefix joins, scans, windows, rates, tiles."""
