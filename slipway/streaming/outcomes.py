"""Run outcomes from a stream of polls.

Both streams take the earliest deciding poll of a run with a built-in minimum, which is
reduced per task before it shuffles; a run that sends a third of all polls is no hot task
there, and no row passes through Python. The runs' terms are the static side of the join:
they are not repeated by a salt, which every small batch would pay for again. Landed rows
are only ever replaced by earlier ones, so the earliest landed decision of a run is its
outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from slipway.functions import telemetry as L
from slipway.operators.telemetry import deciding_polls, first_decision, with_terms

DECISION = (
    "run_id string, poll_ts timestamp, verdict int, exit_code bigint, "
    "elapsed_seconds double, spent double"
)


def decisions(polls: DataFrame, runs: DataFrame) -> DataFrame:
    """Streaming, update mode: the earliest deciding poll known so far for every run.

    A decision shows at once, and an earlier poll that comes late replaces it, however
    late it is. The state is one small row per ended run.
    """
    return (
        deciding_polls(with_terms(polls, runs, salts=1))
        .groupBy("run_id")
        .agg(first_decision().alias("first"))
        .select("run_id", "first.*")
    )


def settled_decisions(
    polls: DataFrame, runs: DataFrame, *, lateness: str = "10 minutes", window: str = "5 minutes"
) -> DataFrame:
    """Streaming, append mode: the first deciding poll of every run and window, once settled.

    A row comes out when no poll of its window can arrive any more, and its state is
    dropped then, so the state holds open windows only. Polls later than ``lateness`` are
    ignored. The first window of a run is final; later ones repeat that it has ended.
    """
    met = with_terms(polls.withWatermark("poll_ts", lateness), runs, salts=1)
    return (
        deciding_polls(met)
        .groupBy("run_id", F.window("poll_ts", window))
        .agg(first_decision().alias("first"))
        .select("run_id", "first.*")
    )


def write_decisions(updates: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writer for update mode: each micro-batch has its own folder, which a repeat overwrites."""

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(land)
    )


def write_settled(settled: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writer for append mode: a parquet table that holds every row once."""
    return (
        settled.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", folder)
    )


def read_outcomes(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """Outcome of every run from the landed rows of either writer."""
    first = (
        spark.read.schema(DECISION)
        .parquet(folder)
        .groupBy("run_id")
        .agg(first_decision().alias("_first"))
    )
    return runs.join(first, "run_id", "left").select(
        *runs.columns,
        L.outcome_name(F.col("_first.verdict"), F.col("_first.exit_code")).alias("outcome"),
        F.col("_first.exit_code").alias("exit_code"),
        F.col("_first.elapsed_seconds").alias("elapsed_seconds"),
        F.col("_first.spent").alias("spent"),
    )


def spend_alerts(decided: DataFrame) -> DataFrame:
    """Streaming: of either kind of decisions, those by the spend limit."""
    return decided.filter(F.col("verdict") == L.MAX_SPEND).select(
        "run_id", "poll_ts", "elapsed_seconds", "spent"
    )
