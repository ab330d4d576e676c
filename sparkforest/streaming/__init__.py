"""Structured Streaming: a stream of batches applied to a forest."""
