"""Labelled-dataset audit, leakage-safe splitting and classifier evaluation on Spark."""
