"""Stored tables, tables from elsewhere, and where they are kept."""
