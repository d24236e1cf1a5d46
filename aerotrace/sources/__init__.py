"""Readers and writers for mission files."""
