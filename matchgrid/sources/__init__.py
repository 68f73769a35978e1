"""Readers of nested documents and listings."""
