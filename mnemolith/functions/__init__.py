"""Column functions: text, vectors, relevance factors."""
