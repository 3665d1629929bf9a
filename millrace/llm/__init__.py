"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  ``queries.py`` holds the
registered queries and ``oracles.py`` their SQL.
"""
