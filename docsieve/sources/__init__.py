"""Readers and writers of the document formats."""
