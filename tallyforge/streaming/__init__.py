"""Streams over the operators."""
