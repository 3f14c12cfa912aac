"""Structured Streaming jobs, each with the batch operators as its body."""
