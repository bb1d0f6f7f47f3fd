"""Tile pyramids, viewport delivery and their stream mechanics as Spark plans."""
