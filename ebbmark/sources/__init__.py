"""Scans, type inference, sinks and the run log."""
