"""Structured Streaming sources and stateful reassembly."""
