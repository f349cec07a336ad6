"""Structured Streaming: watching for results, stateful batching."""
