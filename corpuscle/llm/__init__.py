"""Operators on training text and large columns; nothing else in the library imports them."""
