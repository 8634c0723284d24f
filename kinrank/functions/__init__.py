"""Catalyst column expressions.  Nothing here runs Python per row."""
