"""Sources of evenkeel."""
