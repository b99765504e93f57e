"""Whole analyses: classification, alerts, summaries, incidents, archives."""
