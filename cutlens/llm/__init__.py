"""Operators that turn a text, vector or page corpus into training data."""
