"""Structured Streaming into graph tables."""
