"""Per-article state on Structured Streaming."""
