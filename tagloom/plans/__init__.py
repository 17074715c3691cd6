"""Shared plan shapes: ordered scans, shared folders, the sync loop."""
