"""Changelogs as streams."""
