"""Operators from DataFrame to DataFrame.

A table of sequences has columns ``id`` and ``seq`` (others are ignored); lists of sequences
of equal length are such tables too.
"""
