"""Readers and writers of the file layouts."""
