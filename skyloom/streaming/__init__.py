"""Structured Streaming: the track operators over positions as they arrive."""
