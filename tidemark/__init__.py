"""Spark-first analytics for minute bars, events and reference tables."""
