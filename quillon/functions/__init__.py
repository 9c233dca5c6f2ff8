"""Scalar building blocks: wire primitives, codecs over bytes, and Column expressions."""
