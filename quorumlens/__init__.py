"""Causally versioned, replicated key-value data as Spark plans."""
