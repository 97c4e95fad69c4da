"""Micro-batch versions of the replay-safe merges."""
