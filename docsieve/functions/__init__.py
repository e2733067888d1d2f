"""Scalar kernels, value semantics and the column plane."""
