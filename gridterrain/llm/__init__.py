"""Operators of a training-data pipeline over documents, vectors and pages.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
