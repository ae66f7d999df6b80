"""Scalar functions: one text normalization contract, ids, escapes."""
