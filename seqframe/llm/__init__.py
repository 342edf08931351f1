"""Training-data operators.

Nothing else in the library imports this subpackage; it may be deleted whole.
Every module holds one operator with a general interface, plus the thin query
that the driver entry registers for it.
"""
