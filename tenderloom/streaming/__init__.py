"""Structured Streaming forms of the reports."""
