"""Reusable DataFrame operators (core)."""
