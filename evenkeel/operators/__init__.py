"""Operators of evenkeel."""
