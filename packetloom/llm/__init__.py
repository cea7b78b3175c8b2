"""Operators over text corpora: extraction, scoring, deduplication, decontamination, packing."""
