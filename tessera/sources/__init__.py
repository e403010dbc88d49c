"""Readers for tables and catalogue formats."""
