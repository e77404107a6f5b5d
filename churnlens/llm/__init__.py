"""Operators for building language-model training data on Spark.

Each module holds one operator with a general interface and the thin
``opN_<name>`` query that applies it to a whole test table.  Nothing
outside this subpackage imports it.
"""
