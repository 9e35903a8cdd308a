"""Readers and writers of labelled numeric tables."""
