"""Document vectors, the postings index and the vocabulary as tables."""
