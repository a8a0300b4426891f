"""Numpy kernels and column expressions."""
