"""Named queries, their SQL, and the runs that build everything from a dump."""
