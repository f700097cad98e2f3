"""Incremental census: new ``files`` batches processed as they land."""
