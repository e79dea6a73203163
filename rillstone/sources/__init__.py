"""Readers that give every log the same columns."""
