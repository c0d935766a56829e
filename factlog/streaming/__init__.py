"""Structured Streaming into the fact log."""

from .ingest import follow

__all__ = ["follow"]
