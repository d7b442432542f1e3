"""Readers: canonical tables, saved HTML, progress files."""
