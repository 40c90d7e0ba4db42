"""Feeds, archives, pages, tracks and the persisted store."""
