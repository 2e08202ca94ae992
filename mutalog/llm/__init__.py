"""Operators for building training data, each over whole tables."""
