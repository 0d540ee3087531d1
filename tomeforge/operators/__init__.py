"""Operators over pages: links, counts, lookups, search, output rows, linking."""
