"""Training-data operators: filtering, deduplication, tokenisation, packing and storage of text corpora.

Nothing outside this subpackage imports it.
"""
