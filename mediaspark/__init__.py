"""Spark jobs for media libraries and playback fleets."""
