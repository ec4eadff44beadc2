"""Relational operators of the audit: matching, rules, costs, runs."""
