"""Readers and writers of document containers, as Python data sources, table functions and Arrow maps."""
