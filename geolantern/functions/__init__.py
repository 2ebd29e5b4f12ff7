"""Column functions: geography, vectors, tags and query text."""
