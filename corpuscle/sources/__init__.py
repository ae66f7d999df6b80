"""Readers and writers of dump, table and event files."""
