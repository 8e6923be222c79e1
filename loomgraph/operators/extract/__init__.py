"""Extraction jobs that turn a ``files`` table into fragment tables."""
