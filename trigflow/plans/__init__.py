"""Composed analyses and the queries over the shared test tables."""
