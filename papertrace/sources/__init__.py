"""Readers and writers of the audit's files."""
