"""Readers and writers, and the record tables derived from the driver's tables."""
