"""Requests that arrive over time."""
