"""Structured streaming forms of the operators."""
