"""Streaming forms, an addition of this engine."""
