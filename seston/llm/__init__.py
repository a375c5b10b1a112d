"""Operators over text and measurements for curating training data."""
