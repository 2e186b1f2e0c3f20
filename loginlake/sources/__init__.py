"""Readers of log files and login snapshots, and lines derived from an events table."""
