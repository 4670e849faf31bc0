"""Scans, file readers, sinks and derived fixtures."""
