"""Readers for landed payloads, table schemas and table maintenance."""
