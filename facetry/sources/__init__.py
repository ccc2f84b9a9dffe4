"""Readers: every text format becomes a table by expressions over its lines."""
