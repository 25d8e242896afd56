"""Operators for preparing training text: ten methods over documents and pages.

Nothing else in the library imports this subpackage; it can be removed without
touching the rest.
"""
