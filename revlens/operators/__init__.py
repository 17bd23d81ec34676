"""Relational operators of revision analytics; each takes and returns DataFrames."""
