"""Operators that prepare text for the training of language models.

Nothing outside this subpackage imports it.
"""
