"""Millrace: a PySpark library for collected web, marketplace and telemetry data."""
