"""Operators for preparing training data at scale.

Each module holds one operator with a general interface; :mod:`queries`
applies them to the test tables.  Nothing outside this folder imports it.
"""
