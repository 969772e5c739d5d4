"""Readers and writers of label, prediction and task files."""
