"""Readers and writers for scans, prediction documents, CSV tables and logs."""
