"""Scans, landing, sinks and the dataset catalog."""
