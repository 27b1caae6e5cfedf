"""Registered queries: operators applied to tables, each with independent SQL where SQL can express it."""
