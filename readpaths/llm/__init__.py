"""Operators for preparing training text: extraction, de-duplication, quality,
archives, tokens, search, scoring, URL filters and mixing.

Nothing else in the library imports this subpackage.
"""
