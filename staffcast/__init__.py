"""Workforce utilisation rates and what-if planning on Spark."""
