"""Attendance risk analytics on Spark."""
