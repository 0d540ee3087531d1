"""Encyclopedia-dump analytics as Spark plans."""
