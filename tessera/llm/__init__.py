"""Training-data operators: each module holds one operator with a general interface.

Nothing else in the library imports this subpackage; ``queries.py`` binds the operators to
the driver's tables.
"""
