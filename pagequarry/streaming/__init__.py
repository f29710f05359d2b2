"""Structured Streaming jobs over ledgers and event tables."""
