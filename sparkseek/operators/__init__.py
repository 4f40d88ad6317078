"""Operators over searched tables."""
