"""Live transcripts with Structured Streaming."""
