"""Structured Streaming forms of windows and detection runs."""
