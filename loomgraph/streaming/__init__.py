"""Structured Streaming jobs for usage samples and push events."""
