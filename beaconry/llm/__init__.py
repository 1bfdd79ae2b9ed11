"""Operators for training-data corpora: ten document, page and vector jobs.

Nothing else in the library imports this subpackage.
"""
