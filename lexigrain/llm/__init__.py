"""Operators for large-scale training-data preparation (self-contained; nothing else imports it)."""
