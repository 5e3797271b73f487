"""Whole comparisons, and the queries registered for the driver."""
