"""Unbounded runs: watermarks, windows with triggers, jobs."""
