"""Schemas, readers, writers and the retail view of the driver tables."""
