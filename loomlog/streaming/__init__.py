"""Continuous decision of proposals."""
