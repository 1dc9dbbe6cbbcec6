"""The registered queries, each beside the SQL that checks it."""
