"""Relational operators over pages and their node tables."""
