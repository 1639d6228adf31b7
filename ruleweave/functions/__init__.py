"""Scalar expressions as columns."""
