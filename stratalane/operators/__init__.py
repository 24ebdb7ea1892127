"""Operators of the column encoder: profiles, size model, selection, kernels, frames."""
