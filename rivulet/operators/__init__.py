"""Operators on weighted tables and their rules for changes."""
