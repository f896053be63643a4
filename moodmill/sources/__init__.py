"""Readers that turn landed data into the unified document tables."""
