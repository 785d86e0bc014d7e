"""Operators that prepare language-model training data at corpus scale.

Every operator takes and returns DataFrames; nothing outside this subpackage
imports it. See ``queries.py`` for the registered queries.
"""
