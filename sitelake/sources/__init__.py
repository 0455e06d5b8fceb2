"""Readers and writers for web archives, zip files, folders and site tables."""
