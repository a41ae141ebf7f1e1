"""Structured Streaming jobs; the transforms also run on batch frames."""
