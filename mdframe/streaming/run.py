"""Structured Streaming around the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mdframe.engine import Engine
from mdframe.lang.tokens import QueryError


def watermarked(frame: DataFrame, column: str, delay: str, window: str | None = None) -> DataFrame:
    """A stream whose rows may be late by ``delay``; ``window`` adds a column ``window_start`` to group by."""
    from pyspark.sql import functions as F

    out = frame.withWatermark(column, delay)
    return out.withColumn("window_start", F.window(column, window)["start"]) if window else out


def start(engine: Engine, text: str, name: str, mode: str = "append", checkpoint: str | None = None, sink: str = "memory", **options: str) -> StreamingQuery:
    """Run a select over a streaming table into a sink. The checkpoint folder makes it restart where it stopped."""
    frame = engine.sql(text).frame
    if frame is None or not frame.isStreaming:
        raise QueryError("the query reads no stream")
    writer = frame.writeStream.format(sink).outputMode(mode).queryName(name).options(**options)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
