"""Readers, sinks and result caches."""
