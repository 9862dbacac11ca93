"""Operators over node, edge and file tables."""
