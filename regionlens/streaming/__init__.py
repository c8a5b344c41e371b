"""Incremental (Structured Streaming) form of the rates plan."""
