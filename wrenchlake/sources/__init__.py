"""Table schemas, loading and saving, and the mapping from the star-schema test tables."""
