"""Spark-first analytics for multi-turn conversation corpora."""
