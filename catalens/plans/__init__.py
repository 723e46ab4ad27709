"""Query parsing and the catalogue of registered queries with their SQL."""
