"""Readers for dumps, registries and result files."""
