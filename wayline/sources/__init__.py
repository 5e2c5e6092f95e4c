"""Canonical tables from files and from other tables."""
