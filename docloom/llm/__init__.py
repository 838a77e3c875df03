"""Operators for preparing training text at scale, one module each, and the queries that run them."""
