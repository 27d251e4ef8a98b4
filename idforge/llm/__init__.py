"""Operators for preparing large training corpora.

Nothing outside this package imports it; deleting the folder leaves the rest
of the library working.
"""
