"""Whole flows: snapshots, the index run, and the tools."""
