"""Scalar and type semantics."""
