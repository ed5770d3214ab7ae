"""Scalar functions as Columns: values, templates, conditions, text."""
