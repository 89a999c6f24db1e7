"""Streaming forms of the index view and of duplicate detection."""
