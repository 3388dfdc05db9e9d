"""Evaluation analytics for labelled predictions, as Spark DataFrame operators."""
