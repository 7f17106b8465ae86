"""Analytic operators, one module per family."""
