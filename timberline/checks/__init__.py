"""Registered queries over the given tables, and the SQL that tells their expected results."""
