"""Landed payloads to records, and state tables in and out."""
