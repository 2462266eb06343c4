"""Incremental forms of the state operators, on Structured Streaming."""
