"""Relational plans as SQL text over named inputs; Catalyst optimises each as one query."""
