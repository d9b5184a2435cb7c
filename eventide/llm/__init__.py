"""Operators for training-data pipelines: thirteen corpus operators and the queries that apply them.

Nothing outside this package imports it, except the registry guard in ``__spark_entry__.py``.
"""
