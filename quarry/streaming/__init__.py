"""Structured Streaming: live latency quantiles. Index builds are batch jobs."""
