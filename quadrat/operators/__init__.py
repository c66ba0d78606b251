"""Reusable DataFrame operators; each takes frames plus column names."""
