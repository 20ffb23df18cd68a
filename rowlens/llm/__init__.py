"""Operators for preparing training text, each a set of Spark jobs.

Nothing outside this subpackage imports it, so it can be removed without
touching the record-inspection engine.
"""
