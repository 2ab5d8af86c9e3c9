"""Scalar building blocks: word lists, text expressions and small statistics, all Spark columns."""
