"""Structured Streaming forms of the activity and ingestion operators."""
