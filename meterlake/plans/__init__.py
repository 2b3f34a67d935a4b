"""Stored results: what is kept, when it is valid, and which way a report takes."""
