"""Readers, writers and the adapter views over the given parquet tables."""
