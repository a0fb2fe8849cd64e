"""Operators for preparing training text: one module per operator, queries in ``queries.py``.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
