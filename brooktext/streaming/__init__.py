"""Scoring over streams; an extension of our own."""
