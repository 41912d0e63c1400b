"""Operators on point clouds: each takes and returns DataFrames."""
