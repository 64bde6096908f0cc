"""Alphabets, tree shapes and the registered queries."""
