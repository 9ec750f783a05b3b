"""Filters and views, compiled to predicates."""
