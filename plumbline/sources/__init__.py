"""Readers and writers of scans and their metadata."""
