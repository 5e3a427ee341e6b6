"""Readers and writers: pages, feeds, lists, CSV, weights."""
