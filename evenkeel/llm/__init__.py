"""Operators for cleaning, comparing and tokenizing training text."""
