"""Relational operators over records, text and layout primitives."""
