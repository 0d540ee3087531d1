"""Column functions: wiki markup, and words of a text."""
