"""Operators for preparing training data for language models.

Each module holds one operator with its own general interface; ``queries``
applies them to the shared tables. Nothing else in the package imports this one.
"""
