"""Operators for training-data corpora: filtering, deduplication, extraction and tokenisation."""
