"""Scalar expressions that several operators use."""
