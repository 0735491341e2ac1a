"""Spark ML pipelines, calibration, explanation and persistence."""
