"""Structured Streaming forms of the summaries (an extension; the batch operators are the reference)."""
