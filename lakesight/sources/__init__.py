"""Readers, writers and the versioned table store."""
