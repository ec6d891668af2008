"""Slice a review graph and roll the slices up, on Spark DataFrames."""

from graphslice.model import GraphSlice, PropertyGraph

__all__ = ["GraphSlice", "PropertyGraph"]
