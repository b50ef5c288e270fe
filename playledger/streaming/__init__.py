"""Continuous form of the upload step."""

from .landing import stream_plays

__all__ = ["stream_plays"]
