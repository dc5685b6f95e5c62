"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it; `queries.py` holds the registered
queries and the SQL they are compared with.
"""
