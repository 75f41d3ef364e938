"""Whole plans: scoring a run, rebuilding it from replies, auditing protocols."""
