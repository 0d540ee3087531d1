"""Counting of pages as they arrive, with the plans that batches use."""
