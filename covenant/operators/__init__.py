"""Audits, evolution, diffs, graphs, policies and partitions."""
