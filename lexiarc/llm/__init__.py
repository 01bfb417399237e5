"""Operators for preparing large text collections for language models.

Nothing else in the library imports this subpackage.
"""
