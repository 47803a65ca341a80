"""Metrics over unbounded input."""
