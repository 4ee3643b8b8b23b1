"""Operators for preparing training text: one module per operator, ``registry`` for the registered queries.

Nothing else in the package imports this subpackage.
"""
