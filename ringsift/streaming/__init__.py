"""The event path on Structured Streaming."""
