"""Operators for building training data for language models.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
