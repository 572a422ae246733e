"""Readers and writers: snapshot folders, ingest, export."""
