"""Structured Streaming forms of the merge and of stateful rules."""
