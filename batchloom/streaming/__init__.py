"""Continuous forms of the operators."""
