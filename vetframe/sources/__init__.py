"""Readers of labelled datasets into canonical tables."""

from .detect import detect_format, read_dataset

__all__ = ["detect_format", "read_dataset"]
