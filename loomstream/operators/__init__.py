"""Stages, tags, sub-queries, offsets, observers and writing."""
