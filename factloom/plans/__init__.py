"""Whole flows built from the operators, and the catalogue of runnable queries."""
