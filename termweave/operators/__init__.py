"""Operators over term tables."""
