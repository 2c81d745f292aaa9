"""Structured Streaming forms of the event operators, with their batch twins."""
