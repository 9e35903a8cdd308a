"""Streaming forms of the stateless jobs."""
