"""Operators over content records."""
