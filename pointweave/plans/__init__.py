"""Pipelines: configuration, map building and registration."""
