"""Structured Streaming into and out of segment stores."""
