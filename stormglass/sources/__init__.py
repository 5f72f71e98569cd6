"""Feeds: documents to alert rows, connectors and settings."""
