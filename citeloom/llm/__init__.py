"""Operators that prepare training text: one module for each, all on Spark DataFrames.

Nothing outside this folder imports it.
"""
