"""Scalar expressions over Columns."""
