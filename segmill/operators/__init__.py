"""Operators over segments, postings and vectors."""
