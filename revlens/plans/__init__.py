"""Bindings of the operators to the supplied tables, each with the SQL it is held against."""
