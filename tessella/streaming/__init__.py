"""Structured Streaming forms of the chunker and of the request exchange."""
