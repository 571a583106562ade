"""Readers and JSON envelopes."""
