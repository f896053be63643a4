"""Structured Streaming jobs over the event firehose."""
