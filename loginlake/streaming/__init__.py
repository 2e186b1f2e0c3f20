"""Continuous ingest of log segments and login snapshots."""
