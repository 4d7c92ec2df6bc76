"""Operators for preparing training data at scale.

Nothing else in the package imports this one; it may be deleted as a whole.
"""
