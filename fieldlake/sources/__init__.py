"""Readers and writers of the lake's tables and files."""
