"""Readers for the raw files and the staged tables."""
