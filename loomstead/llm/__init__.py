"""Operators for training data: vector search, conversations, splitting, markup, tokens, mixing, shared spans.

Nothing outside this folder imports it. The queries are in ``queries``.
"""
