"""Structured Streaming versions of the run telemetry."""
