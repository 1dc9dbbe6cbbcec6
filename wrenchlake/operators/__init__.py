"""DataFrame-to-DataFrame operators: lookups, pricing, stock, contacts, edits, windows."""
