"""Queries that apply the operators to whole driver tables, and their SQL."""
