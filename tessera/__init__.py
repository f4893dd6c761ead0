"""Tessera: analytics operators written on Spark DataFrames.

Operators are functions from DataFrames to DataFrames.  Anything that can be a
declarative plan is one; Python runs only inside Arrow batches or bounded groups.
"""
