"""Lesson analytics expressed as Spark plans."""
