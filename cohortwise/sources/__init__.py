"""Readers that turn files and the driver's tables into listing-shaped frames."""
