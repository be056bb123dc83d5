"""Readers, writers, source inventory, extraction and the module cache."""
