"""Operators over scans: counts, parallel queries, zone maps."""
