"""Whole jobs, and the queries registered for the driver."""
