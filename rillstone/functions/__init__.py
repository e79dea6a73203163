"""Scalar functions of event columns."""
