"""Operators for training data: tokens, extraction, duplicates, shards and classifiers.

Nothing outside this folder and ``corpus_pipeline`` imports it.
"""
