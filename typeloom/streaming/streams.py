"""Checking and fixing streams: the same projections, which keep no state, over streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from typeloom.operators import engine
from typeloom.plans.styles import Style


def check_stream(source: DataFrame, style: Style, text: str = "text") -> DataFrame:
    return engine.check(source, style, text)


def fix_stream(source: DataFrame, style: Style, text: str = "text") -> DataFrame:
    return engine.changed(source, style, text)


def width_stream(source: DataFrame, by: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """A running survey of French no-break spaces, for the output modes update and complete."""
    return engine.survey_width(source, by, text)


def start(df: DataFrame, out: str, checkpoint: str, format: str = "parquet", trigger: str | None = None) -> StreamingQuery:
    """Append to `out`; with `trigger` a processing interval, else all that is there and stop."""
    writer = df.writeStream.format(format).option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
