"""The operators that make sense on unbounded input, as Structured Streaming."""
