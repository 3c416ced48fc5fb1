"""Scalar functions as columns, and the driver's vector, matrix and image arithmetic."""
