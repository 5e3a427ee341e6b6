"""Operators that score messages and pages."""
