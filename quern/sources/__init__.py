"""Readers and writers of truth tables, predictions, replies, logs and reports."""
