"""Operators for building language-model training corpora.

Nothing outside this folder imports it; the queries are in :mod:`sediment.llm.catalog`.
"""
