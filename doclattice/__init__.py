"""Reconciling documentation from unequal sources onto a table of symbols, on Spark."""
