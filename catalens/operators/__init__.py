"""Operators on the op log, the live view and the postings."""
