"""Spark library that builds ranked, deduplicated and indexed material catalogs."""
