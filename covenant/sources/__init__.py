"""Snapshots of catalogs and the write gate."""
