"""Clauses and result shapes: each compiles to a lazy DataFrame."""
