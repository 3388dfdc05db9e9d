"""Training-data operators: deduplication, extraction, scoring, mixing, search and tokenisation.

Nothing outside this subpackage imports it, so it can be removed without
touching the analytics library.
"""
