"""Metafile analytics on Spark."""
