"""Operators over facts, text, vectors, tables and answers."""
