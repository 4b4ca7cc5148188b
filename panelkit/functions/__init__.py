"""Column helpers and tail probabilities."""
