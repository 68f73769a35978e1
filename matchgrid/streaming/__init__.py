"""Stateful operators on streams of metric events."""
