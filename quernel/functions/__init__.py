"""Part of the search and analytics engine."""
