"""Operators for preparing training text: tokens, filters, near copies, secrets."""
