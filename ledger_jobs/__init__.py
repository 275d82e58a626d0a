"""Batch and streaming jobs over bank statements, as DataFrame operations."""
