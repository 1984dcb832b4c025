"""Anomaly and drift models."""
