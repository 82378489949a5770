"""Streaming twins of the request log's operators."""
