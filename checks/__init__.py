"""Registered queries and the plain SQL each one is compared with."""
