"""Training-data pipeline operators.

Nothing else in the library imports this subpackage: it can be deleted and
the relational and index engine keeps working.
"""
