"""Descriptors, predicates, options, and the planner."""
