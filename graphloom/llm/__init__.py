"""Operators of a training-data pipeline: text, tokens, archives and embeddings.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own interface; ``queries.py`` holds the thin registered queries.
"""
