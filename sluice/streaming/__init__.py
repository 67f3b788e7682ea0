"""Structured Streaming: the pipeline over micro-batches, and stateful operators."""
