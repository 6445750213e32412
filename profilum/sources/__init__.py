"""Readers, writers and the input model."""
