"""Encoding, training, calibration and importance on Spark ML."""
