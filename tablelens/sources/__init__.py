"""Readers, type inference and writers."""
