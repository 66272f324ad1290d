"""Readers and writers: CSV with blank markers, JSON records, run tables, models."""
