"""Operators on particle DataFrames (``pid, type, x, y, z, r, i, e``); each takes and returns DataFrames."""
