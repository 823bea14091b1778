"""Bounded query equivalence."""
