"""Streaming front doors: the same results as in batch, as files arrive."""
