"""Operators over DataFrames: inference, reduction, windows, graphs, caching, costs, routing, findings, matching."""
