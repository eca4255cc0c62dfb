"""Column expressions: features, characters, similarity, probability."""
