"""Checks on the driver before a plan is made, and plan helpers."""
