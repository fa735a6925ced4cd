"""Operators for large text corpora: filtering, near duplicates, packing, archives and language models."""
