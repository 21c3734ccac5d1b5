"""Message delivery and keyed state on Structured Streaming."""
