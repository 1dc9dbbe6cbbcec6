"""Views, reports and composed queries over the whole shop."""
