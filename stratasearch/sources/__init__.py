"""Readers: table files, repository trees, registries and configuration."""
