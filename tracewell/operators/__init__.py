"""Relational, temporal and graph operators."""
