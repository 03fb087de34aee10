"""Streaming form of the accumulating operator."""
