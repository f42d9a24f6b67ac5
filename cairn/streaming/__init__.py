"""Structured Streaming sinks, epoch admission and leases."""
