"""Readers and writers of sampled-signal containers, and signal generators."""
