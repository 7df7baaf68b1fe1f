"""Structured Streaming counterparts of the windows."""
