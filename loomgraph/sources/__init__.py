"""Readers and writers: graph files, source files, manifests, the table store."""
