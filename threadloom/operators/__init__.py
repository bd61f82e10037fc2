"""Operators over comments, edges, graphs and text; each takes and returns DataFrames."""
