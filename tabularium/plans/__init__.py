"""Typed calculation plans."""
