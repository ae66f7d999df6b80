"""Matching over texts that arrive in pieces."""
