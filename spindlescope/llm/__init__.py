"""Operators for preparing training text: scoring, extraction, de-duplication, filters, archives and tokens."""
