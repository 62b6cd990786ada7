"""Scalar functions: each has a Column form, built from built-in functions."""
