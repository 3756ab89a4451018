"""Structured Streaming jobs: landing, streaming Silver, run status."""
