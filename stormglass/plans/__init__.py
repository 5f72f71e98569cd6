"""Queries of the driver contract: library operators over the synthetic tables, each with its SQL."""
