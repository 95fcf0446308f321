"""Telemetry on Structured Streaming."""
