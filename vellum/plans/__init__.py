"""Whole plans: search modes, ingest, the knowledge-base API."""
