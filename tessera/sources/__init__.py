"""Readers: source trees, their configuration, and stored indexes."""
