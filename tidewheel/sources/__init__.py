"""Readers, writers, configuration and logging."""
