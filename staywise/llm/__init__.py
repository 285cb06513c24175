"""Operators of a training-data pipeline over document, page and embedding tables.

Nothing else in the package imports this one; ``queries`` registers one query
per operator.
"""
