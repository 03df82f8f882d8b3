"""Operators of a training-data pipeline: tokens, deduplication, quality, search and mixing.

Each module holds one operator with its own interface; ``queries.py`` registers the thin
``opN_<name>`` queries over the shared tables. Nothing outside this subpackage imports it.
"""
