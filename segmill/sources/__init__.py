"""Segment stores and foreign file formats."""
