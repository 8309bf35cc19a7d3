"""Incremental index maintenance."""
