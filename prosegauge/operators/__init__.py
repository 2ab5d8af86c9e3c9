"""Operators: DataFrame in, DataFrame out. Documents are (doc_id, text), one row each."""
