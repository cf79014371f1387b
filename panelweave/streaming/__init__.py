"""Streaming form of the resampling operator."""
