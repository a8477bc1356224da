"""Queries over the given tables, diagrams and rules."""
