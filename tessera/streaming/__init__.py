"""Structured Streaming forms of the batch behaviours: resume, full batches, carried coefficients."""
