"""Readers and writers: tables, the versioned folder format, the directory walker."""
