"""Schemas, rule packs, readers and writers."""
