"""Queries put together from the operators, with the SQL to hold them against."""
