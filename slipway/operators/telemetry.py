"""Run outcomes, spend, events, launch errors and pod readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.functions import telemetry as L
from slipway.functions import text as X
from slipway.functions.joins import SALTS, lookup_join
from slipway.functions.numbers import round_cents

RUN_TERMS = ("run_id", "billing_start", "hourly", "max_spend")


def judged_polls(polls_of_runs: DataFrame) -> DataFrame:
    """Polls that carry their run's terms, with status, spend so far and verdict.

    Each poll is judged alone: finished first, then lost, then over the spend limit. The
    verdict is null for a poll that lets its run go on.
    """
    spent = L.accrued_spend(F.col("billing_start"), F.col("poll_ts"), F.col("hourly"))
    decoded = polls_of_runs.withColumn("_text", L.status_text(F.col("raw_status"))).select(
        "run_id",
        "poll_ts",
        L.decode_status(F.col("_text")).alias("_d"),
        L.elapsed_seconds(F.col("billing_start"), F.col("poll_ts")).alias("elapsed_seconds"),
        spent.alias("spent"),
        L.spend_tripped(spent, F.col("hourly"), F.col("max_spend")).alias("over_limit"),
    )
    return decoded.select(
        "run_id",
        "poll_ts",
        F.col("_d.status").alias("status"),
        F.col("_d.exit_code").alias("exit_code"),
        "elapsed_seconds",
        "spent",
        "over_limit",
        L.poll_verdict(F.col("_d.status"), F.col("over_limit")).alias("verdict"),
    )


def deciding_polls(polls_of_runs: DataFrame) -> DataFrame:
    """The polls that would end their run."""
    return (
        judged_polls(polls_of_runs)
        .filter(F.col("verdict").isNotNull())
        .select("run_id", "poll_ts", "verdict", "exit_code", "elapsed_seconds", "spent")
    )


def with_terms(polls: DataFrame, runs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Polls with the billing terms of their run, a batch or a stream; hot runs are salted."""
    terms = runs.select(*RUN_TERMS)
    return lookup_join(polls, terms, ["run_id"], ["poll_ts"], how="inner", salts=salts)


def accrued_spend(polls: DataFrame, runs: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """Every poll with its decoded status and what its run had cost by then."""
    return judged_polls(with_terms(polls, runs, salts)).drop("verdict")


def first_decision() -> Column:
    """Aggregate giving the earliest deciding poll of a group as a struct."""
    return F.min(F.struct("poll_ts", "verdict", "exit_code", "elapsed_seconds", "spent"))


def run_outcome(
    polls: DataFrame,
    runs: DataFrame,
    *,
    keep_on_failure: Column | bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """How every run ended: success, failed, lost, max_spend, or still running.

    Polls meet their run's terms in a salted join, are judged one by one, and only the
    deciding ones are grouped, with a partial minimum first: a run with a third of all
    polls is spread over the salts and comes to the last step as a few rows. With tables
    bucketed by run, ``salts=1`` leaves no shuffle.
    """
    deciding = deciding_polls(with_terms(polls, runs, salts))
    decided = deciding.groupBy("run_id").agg(first_decision().alias("_first"))
    outcome = L.outcome_name(F.col("_first.verdict"), F.col("_first.exit_code"))
    keep_failed = F.lit(keep_on_failure) if isinstance(keep_on_failure, bool) else keep_on_failure
    return (
        runs.join(decided, "run_id", "left")
        .withColumn("outcome", outcome)
        .select(
            *runs.columns,
            "outcome",
            F.col("_first.exit_code").alias("exit_code"),
            F.col("_first.poll_ts").alias("decided_at"),
            F.col("_first.elapsed_seconds").alias("elapsed_seconds"),
            F.col("_first.spent").alias("spent"),
            L.pod_kept(F.col("outcome"), F.col("keep_pod_on_success"), keep_failed).alias("pod_kept"),
        )
    )


def spend_guard(polls: DataFrame, runs: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """Runs stopped by their spend limit, with what they had spent and the message."""
    stopped = run_outcome(polls, runs, salts=salts).filter(F.col("outcome") == "max_spend")

    def dollars(value: Column) -> Column:
        return F.format_string("%.2f", round_cents(value))

    return stopped.select(
        "run_id",
        "elapsed_seconds",
        "spent",
        "max_spend",
        F.concat(
            F.lit("max spend reached ($"), dollars(F.col("spent")),
            F.lit(" >= $"), dollars(F.col("max_spend")), F.lit(")"),
        ).alias("message"),
    )


def filter_events(events: DataFrame, kind: str | None = None) -> DataFrame:
    """Messages of every run in order, all of them or those of one kind.

    The rows of a run stand together in one partition, in order; runs have no order.
    """
    chosen = events if kind is None else events.filter(F.col("kind") == kind)
    return chosen.select("run_id", "seq", "message").repartition("run_id").sortWithinPartitions("run_id", "seq")


def classify_launch_errors(errors: DataFrame) -> DataFrame:
    """Each error with its class and the data centers its text names."""
    return errors.withColumn(
        "error_class", X.classify_launch_error(F.col("message"))
    ).withColumn("data_centers", X.data_centers(F.col("message")))


def ssh_endpoints(snapshots: DataFrame) -> DataFrame:
    """Every snapshot of a pod with host and port of its SSH endpoint, null while it has none."""
    found = snapshots.withColumn("_document", F.try_parse_json("payload")).withColumn(
        "_endpoint", L.ssh_endpoint(F.col("provider"), F.col("_document"))
    )
    return found.select(
        *snapshots.columns,
        F.col("_endpoint.host").alias("host"),
        F.col("_endpoint.port").alias("port"),
    )


def pod_states(snapshots: DataFrame) -> DataFrame:
    """Every snapshot as (pod_id, provider, observed_ts, state, endpoint): ready, failed or pending."""
    provider, document = F.col("provider"), F.col("_document")
    return (
        snapshots.withColumn("_document", F.try_parse_json("payload"))
        .withColumn("endpoint", L.ssh_endpoint(provider, document))
        .select(
            "pod_id",
            "provider",
            "observed_ts",
            L.pod_state(provider, document, F.col("endpoint")).alias("state"),
            "endpoint",
        )
    )


def pod_readiness(snapshots: DataFrame) -> DataFrame:
    """Whether every pod of a provider became ready, failed, timed out or is still pending.

    The first snapshot that is ready or failed decides, if it came within the provider's
    wait limit after the pod was first seen. Times and counts of all snapshots are one hash
    grouping; only snapshots that decide are read as JSON documents' states and compared.
    """
    pod = ["pod_id", "provider"]
    seen = pod_states(snapshots)
    watched = snapshots.groupBy(*pod).agg(
        F.min("observed_ts").alias("first_ts"),
        F.max("observed_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("snapshots"),
    )
    decided = seen.filter(F.col("state") != "pending").groupBy(*pod).agg(
        F.min(F.struct("observed_ts", "state", "endpoint")).alias("first")
    )
    pods = watched.join(decided, pod, "left")
    limit = F.when(
        F.col("provider") == C.PROVIDERS[0], F.lit(C.READY_TIMEOUT_SECONDS[C.PROVIDERS[0]])
    ).otherwise(F.lit(C.READY_TIMEOUT_SECONDS[C.PROVIDERS[1]]))
    in_time = L.elapsed_seconds(F.col("first_ts"), F.col("first.observed_ts")) < limit
    late = L.elapsed_seconds(F.col("first_ts"), F.col("last_ts")) >= limit
    state = F.when(in_time, F.col("first.state")).when(late, F.lit("timeout")).otherwise(F.lit("pending"))
    endpoint = F.when(in_time & (F.col("first.state") == "ready"), F.col("first.endpoint"))
    return pods.select(
        "pod_id",
        "provider",
        "snapshots",
        state.alias("state"),
        endpoint["host"].alias("host"),
        endpoint["port"].alias("port"),
    )
