"""Readers and writers: file discovery, the chunk store and synchronisation."""
