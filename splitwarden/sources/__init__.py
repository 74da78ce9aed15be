"""Readers with contract checks, and table sinks."""
