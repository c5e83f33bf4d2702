"""Structured Streaming: ingest of delta files with a ledger, and settling of change events."""
