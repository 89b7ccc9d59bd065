"""Schemas, heading mapping, and readers."""
