"""Operators for building text training data, one module per operator.

Nothing else in the package imports this folder. Every operator takes and
returns DataFrames; ``queries`` holds the thin registered queries over them.
"""
