"""Readers: XML dumps, dump indices, separated text, settings, and wiki-shaped views of plain tables."""
