"""Structured Streaming over metric series."""
