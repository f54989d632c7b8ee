"""Functions of evenkeel."""
