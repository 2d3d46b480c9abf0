"""Structured Streaming forms of the time-share and dedupe operators (M1, M2)."""
