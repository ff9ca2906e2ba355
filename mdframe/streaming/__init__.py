"""Queries over streams: a select without ordering or limits runs on a streaming table as it is."""

from mdframe.streaming.run import start, watermarked

__all__ = ["start", "watermarked"]
