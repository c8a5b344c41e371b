"""Scans: parquet tables, wide CSV series, text attribute CSV, GeoJSON, stand-ins."""
