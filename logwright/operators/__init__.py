"""Operators over logs."""
