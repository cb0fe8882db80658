"""Readers, writers and catalogue operators."""
