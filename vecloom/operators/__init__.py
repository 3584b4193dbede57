"""Operators: searches, inverted lists, training, maintenance, key-value data, documents, change feeds."""
