"""Loaders: items, change groups, change logs, exclusion rules."""
