"""Structured Streaming jobs over arriving line items."""
