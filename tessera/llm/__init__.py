"""Training-data pipeline operators.

A self-contained subpackage: nothing else in the library imports it, and it
can be removed as a whole.
"""
