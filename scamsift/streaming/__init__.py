"""Stateful and windowed operators for streams."""
