"""Structured Streaming wiring: jobs and their sinks."""
