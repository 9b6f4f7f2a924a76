"""Operators for training-data pipelines over document tables.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
thin registered queries and ``__spark_entry__.py`` adds them when present.
"""
