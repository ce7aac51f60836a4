"""Structured Streaming in and out."""
