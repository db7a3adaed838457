"""Operators for preparing training text at scale; nothing outside this package imports it.

Each module holds one operator with its own general interface; ``catalog`` binds the operators to
the test tables as the queries ``op1_…`` to ``op13_…``.
"""
