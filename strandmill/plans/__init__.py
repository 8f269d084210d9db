"""Chains of operators, and the command line."""
