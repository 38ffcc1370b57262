"""Whole extraction plans."""
