"""Readers that turn files and tables into rows, nodes and edges."""
