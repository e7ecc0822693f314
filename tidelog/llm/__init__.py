"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Operators whose state is a relation
over hashes (language model, substring, suffix-array and similarity joins)
share the chunk and key-exchange helpers of :mod:`tidelog.llm.common`.
"""
