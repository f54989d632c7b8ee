"""Structured Streaming forms of the change and health operators."""
