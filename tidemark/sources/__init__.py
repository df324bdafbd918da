"""Readers of feeds and writers of results."""
