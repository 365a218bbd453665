"""Structured Streaming forms of the stateful and per-row operators."""
