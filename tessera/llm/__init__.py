"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries`` holds what the entry
module registers, queries and SQL.
"""
