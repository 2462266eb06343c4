"""Column functions: text, addresses, identities, time and scores."""
