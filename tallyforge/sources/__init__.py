"""Readers and writers of tool corpora."""
