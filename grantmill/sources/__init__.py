"""Readers of raw and cleaned tables, and writers of results."""
