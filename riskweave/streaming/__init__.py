"""Structured Streaming upkeep of the latest-sync state (M14) from an arriving event feed."""
