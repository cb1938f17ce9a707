"""Operators for preparing large text corpora.

Nothing else in the package imports this subpackage; ``queries.py`` and ``oracles.py`` hold its registered queries.
"""
