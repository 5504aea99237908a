"""Evaluation plans: temporal splits, the strategy grid, and the engine's queries."""
