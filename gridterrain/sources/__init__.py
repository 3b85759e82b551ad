"""Dimensions, file scans, archive ingest and the persisted postcode table."""
