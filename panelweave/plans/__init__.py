"""Whole preparation flows composed from the operators."""
