"""Readers and writers: source trees, pair tables, index tables."""
