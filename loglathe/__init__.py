"""Spark jobs for newline-delimited logs: read, decode, classify, order, slice, render and follow."""
