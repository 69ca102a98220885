"""Structured Streaming over events (an addition to the reference's event stream)."""
