"""The study's named tables and tests, built from the operators."""
