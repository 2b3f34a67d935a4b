"""Readers that turn a tool's files into sessions and requests, with Spark's own sources."""
