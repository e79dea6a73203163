"""The same stages over a growing log."""
