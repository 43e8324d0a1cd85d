"""Relational operators over nodes and edges."""
