"""Live progress and idle detection with Structured Streaming."""
