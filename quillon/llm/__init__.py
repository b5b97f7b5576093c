"""Training-data operators: tokenising, filtering, searching, deduplicating and mixing.

Nothing else in the library imports this subpackage.
"""
