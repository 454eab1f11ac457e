"""Registered queries and their SQL twins, grouped by layer."""
