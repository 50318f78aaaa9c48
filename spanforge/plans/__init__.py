"""Queries that apply the operators to tables."""
