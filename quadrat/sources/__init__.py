"""Readers: study files in CSV form, and a study laid over star-schema tables."""
