"""Operators that a pipeline for training data needs.

Nothing else in the library imports this package.
"""
