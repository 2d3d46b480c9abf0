"""Operators of a training-data pipeline: token files, near-duplicates, toxicity, web
archives, page extraction, exact-substring dedup, personal data, BPE, exact top-k
search and benchmark decontamination. Nothing else in the library imports this."""
