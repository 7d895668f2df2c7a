"""Operators of a training-data pipeline: chat formatting, toxicity, packing, token files,
near and exact duplicates, secret scans, language-model scores, vector search, byte-level BPE.

Nothing else in the library imports this package.
"""
