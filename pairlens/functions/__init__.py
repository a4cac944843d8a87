"""Column expressions: labels, answer parsing, log-probabilities, similarity, messages, statistics."""
