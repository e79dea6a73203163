"""Stages over an event log, log reads and checks, and request metrics."""
