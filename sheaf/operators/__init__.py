"""Decoding and encoding of tables."""
