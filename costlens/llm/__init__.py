"""Operators for preparing large text corpora (training data) on Spark.

One module per operator, plus shared helpers (``text``, ``scratch``,
``components``).  Nothing outside this package imports it.
"""
