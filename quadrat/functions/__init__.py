"""Column expressions: missing-value rules, text clean-up and probabilities."""
