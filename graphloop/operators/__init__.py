"""Relational operators, combiners, mutation, and the algorithm library."""
