"""Readers and writers: message topics, catalogue pages, dated and incremental tables."""
