"""Loaders and adapters."""
