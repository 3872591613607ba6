"""Whole preparations and the registered queries."""
