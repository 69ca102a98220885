"""Readers and the financial data model over the available tables."""
