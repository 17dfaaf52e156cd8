"""Column functions: labels, names, tokens, tiers, hashing."""
