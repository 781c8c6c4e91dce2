"""Operators for preparing language-model training text: thirteen Spark jobs and their registered queries.

Nothing else in the package imports this subpackage.
"""
