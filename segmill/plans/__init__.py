"""Requests and the catalogue of queries."""
