"""Spark-first analytics for parallel multilingual fact datasets."""
