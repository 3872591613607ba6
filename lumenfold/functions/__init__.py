"""Column functions: labels, identifiers, curve arrays and model scores."""
