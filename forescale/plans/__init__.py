"""Composed steps, the binding of the given tables to the data model, and the named queries."""
