"""Planned changes and the checks around them."""
