"""Structured Streaming jobs over appended response logs."""
