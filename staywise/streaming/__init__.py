"""Structured Streaming twins of the daily batch steps (L1-L4)."""
