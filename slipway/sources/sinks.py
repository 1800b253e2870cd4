"""Writers of plans, reports and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with its keys in alphabetical order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """JSON lines with sorted keys; nulls are written, as the settings files have them."""
    as_json(df).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, *, path: str | None = None) -> None:
    """A table bucketed and sorted by ``key``, for joins and groupings without a shuffle."""
    writer = df.write.bucketBy(buckets, key).sortBy(key).format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def append_events(events: DataFrame, path: str) -> None:
    """Events added to an event table."""
    events.write.mode("append").parquet(path)


def stream_events(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that adds a stream of events to an event table, every event once."""
    return (
        events.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
