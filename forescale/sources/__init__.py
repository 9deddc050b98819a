"""Scans, catalogue reads and normalisers of landed payloads."""
