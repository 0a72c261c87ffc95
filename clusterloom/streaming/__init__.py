"""Keyed rate budgets and progress of streams."""
