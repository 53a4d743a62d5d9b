"""Scalar rules as Column expressions: text, numbers, dates, tax ids and identities."""
