"""Schemas, readers, writers and the tables that stand in for bar data."""
