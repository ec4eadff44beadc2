"""Operators for preparing training data: tokenising, archiving, deduplication, filtering, sharding and mixing."""
