"""Readers and writers: snapshots, remote tables, markdown, feeds, JSON."""
