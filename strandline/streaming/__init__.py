"""Structured Streaming forms of the timeline operators."""
