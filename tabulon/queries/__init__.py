"""Registered queries, by section."""
