"""Structured Streaming jobs over request rows."""
