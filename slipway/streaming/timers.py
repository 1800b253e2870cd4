"""Decisions that fall due without a row: event-time timers per pod and per run.

A pod that falls silent still runs into its wait limit, and a run whose polls stop still
reaches its spend limit, since spend grows with time alone. Either has a timer in the state
of its key, and the watermark sets it off. Ahead of the state every task cuts a batch of
rows to the few of each key that can matter, so a pod or run with a third of all rows comes
to its state as a few rows per batch. Pods are many and short-lived: those of one part share
a state, a table of theirs, and are merged and settled as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slipway import constants as C
from slipway.functions import telemetry as L
from slipway.operators.telemetry import pod_states, with_terms

#: Stands for a time that has not come, in microseconds.
NEVER = (1 << 63) - 1
#: How long a settled key is remembered after its last row, in seconds.
FORGET_SECONDS = 86_400
#: Parts the pods are put into by hash; it has to stay the same as long as a checkpoint lives.
PARTS = 256


def _keeper(merge: Callable, due_of: Callable, result: Callable, columns: list[str], forget: int) -> Callable:
    """The state function of a key. The state ends with a flag that says whether it is settled.

    ``merge(held, frames)`` takes rows into the values held, ``due_of(key, held)`` says when
    they settle, ``result(key, held)`` gives the row to send then, or none. A key with new
    rows is not timed out in that batch, so what is due by then is settled at once.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, settled = state.get if state.exists else (None, False)
        if state.hasTimedOut and settled:
            state.remove()
            return
        if not settled:
            if not state.hasTimedOut:
                held = merge(held if state.exists else None, frames)
            due = -(-due_of(key, held) // 1000)
            settled = state.hasTimedOut or due <= state.getCurrentWatermarkMs()
            if settled and (row := result(key, held)) is not None:
                yield pd.DataFrame([row], columns=columns)
        state.update((*held, settled))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + forget * 1000 if settled else due)

    return keep


_POD = ["pod_id", "provider"]
_ORDER = ["at", "state", "host", "port"]
#: What is held of a pod: its first snapshot, the first that decides, and until when it is
#: remembered in milliseconds, which is ``NEVER`` as long as it is open.
_HELD = pa.schema(
    [("pod_id", pa.string()), ("provider", pa.string()), ("first", pa.int64()), ("at", pa.int64()), ("state", pa.string())]
    + [("host", pa.string()), ("port", pa.int64()), ("until", pa.int64())]
)


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as writer:
        writer.write_table(pa.Table.from_pandas(held[_HELD.names], _HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_pandas()


def _with_snapshots(held: pd.DataFrame | None, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The pods held with new snapshots taken in; ``met`` marks those that have some."""
    parts = [] if held is None else [held.assign(met=False)]
    for frame in frames:
        pending = (frame["state"] == "pending").to_numpy()
        # The first of all counts whatever its state; only a deciding one has a time to decide at.
        parts.append(
            pd.DataFrame(
                {
                    **{name: frame[name].to_numpy() for name in (*_POD, "state")},
                    "first": frame["at"].to_numpy(),
                    "at": np.where(pending, NEVER, frame["at"].to_numpy()),
                    "host": np.where(pending, "", frame["host"].to_numpy()),
                    "port": np.where(pending, -1, frame["port"].to_numpy()),
                    "until": NEVER,
                    "met": True,
                }
            )
        )
    rows = pd.concat(parts, ignore_index=True).sort_values(_ORDER)
    pods = rows.groupby(_POD, sort=False)
    found = rows[~rows.duplicated(_POD)].copy()
    for name, how in (("first", "min"), ("until", "min"), ("met", "max")):
        found[name] = pods[name].transform(how)[found.index]
    return found


def readiness_decisions(
    snapshots: DataFrame, *, lateness: str = "10 minutes", forget_seconds: int = FORGET_SECONDS, parts: int = PARTS
) -> DataFrame:
    """Streaming, append mode: (pod_id, provider, state, first_ts, decided_at, host, port), once per pod.

    A pod is ready or failed by its first such snapshot, if that came within the provider's wait
    limit after the first of all, else ``timeout`` at the limit, whether or not a snapshot comes
    then. Rows come out when the watermark has passed ``decided_at``, so the order in which
    snapshots arrive does not matter; later ones than ``lateness`` are ignored, and repeats
    change nothing. Snapshots without pod, provider or time are left out. A settled pod is
    remembered until ``forget_seconds`` after its last snapshot; then its state is dropped.

    The pods of each of ``parts`` parts are one state, whose timer is the earliest of theirs. It
    is written again when one of them has a snapshot or falls due, so many open pods and small
    batches call for more parts.
    """
    limits = {provider: seconds * 1_000_000 for provider, seconds in C.READY_TIMEOUT_SECONDS.items()}
    other = limits[C.PROVIDERS[1]]
    seen = pod_states(snapshots.dropna(subset=[*_POD, "observed_ts"])).select(
        F.pmod(F.xxhash64(*_POD), F.lit(parts)).cast("int").alias("part"),
        *_POD,
        "observed_ts",
        F.unix_micros("observed_ts").alias("at"),
        "state",
        F.coalesce("endpoint.host", F.lit("")).alias("host"),
        F.coalesce(F.col("endpoint.port").cast("long"), F.lit(-1).cast("long")).alias("port"),
    )

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values(_ORDER)
            decided = frame[frame["state"] != "pending"]
            first, last = ~frame.duplicated(_POD), ~frame.duplicated(_POD, keep="last")
            kept = first | last
            kept[decided.index[~decided.duplicated(_POD)]] = True
            yield frame[kept]

    def keep(part: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = _unpacked(state.get[0]) if state.exists else None
        held = held.assign(met=False) if state.hasTimedOut else _with_snapshots(held, frames)
        limit = held["first"] + held["provider"].map(limits).fillna(other).astype("int64")
        due = -(-np.minimum(limit, held["at"]) // 1000)
        settles = (held["until"] == NEVER) & (due < now)
        if settles.any():
            row, limit_of = held[settles], limit[settles]
            by_state = row["at"] < limit_of
            yield pd.DataFrame(
                {
                    **{name: row[name] for name in _POD},
                    "state": row["state"].where(by_state, "timeout"),
                    "first_us": row["first"],
                    "decided_us": row["at"].where(by_state, limit_of),
                    "host": row["host"].where(by_state, ""),
                    "port": row["port"].where(by_state, -1),
                }
            )
        again = settles | (held["met"] & (held["until"] != NEVER))
        held["until"] = held["until"].mask(again, now + forget_seconds * 1000)
        timer = held["until"].where(held["until"] != NEVER, due)
        remembered = timer >= now
        if not remembered.any():
            state.remove()
            return
        state.update((_packed(held[remembered]),))
        state.setTimeoutTimestamp(int(timer[remembered].min()))

    settled = (
        seen.mapInPandas(reduced, seen.schema)
        .withWatermark("observed_ts", lateness)
        .groupBy("part")
        .applyInPandasWithState(
            keep,
            "pod_id string, provider string, state string, first_us long, decided_us long, host string, port long",
            "held binary",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    ready = F.col("state") == "ready"
    return settled.select(
        *_POD,
        "state",
        F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("decided_us").alias("decided_at"),
        F.when(ready, F.col("host")).alias("host"),
        F.when(ready, F.col("port").cast("int")).alias("port"),
    )


def spend_crossings(
    polls: DataFrame, runs: DataFrame, *, lateness: str = "10 minutes", forget_seconds: int = FORGET_SECONDS
) -> DataFrame:
    """Streaming, append mode: (run_id, billing_start, crossed_at, spent) of runs that reach their spend limit.

    Spend grows with time, so the instant is known from the first poll on; the alert falls due
    then, without a poll that tells of it. A poll that ends the run by that instant withdraws
    it. Rows come out when the watermark has passed the instant, once per run; polls later than
    ``lateness`` are ignored, repeats change nothing. Only runs with a price and a limit
    take part, and only their polls move the watermark. A settled run is remembered until
    ``forget_seconds`` after its last poll.
    """
    start = F.unix_micros("billing_start")
    allowed = F.ceil(F.col("max_spend") / F.col("hourly") * F.lit(3600.0) * F.lit(1e6)).cast("long")
    status = L.decode_status(L.status_text(F.col("raw_status")))["status"]
    limited = (F.col("hourly") > 0) & (F.col("max_spend") > 0) & F.col("poll_ts").isNotNull()
    seen = (
        with_terms(polls, runs, salts=1)
        .filter(limited & F.col("billing_start").isNotNull())
        .select(
            "run_id",
            "poll_ts",
            F.when(status == "running", F.lit(NEVER)).otherwise(F.unix_micros("poll_ts")).alias("ended"),
            start.alias("start"),
            (start + allowed).alias("due"),
            "max_spend",
        )
    )
    terms = ["start", "due", "max_spend"]

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ended = frame.sort_values("ended").groupby("run_id", sort=False).head(1)
            kept = pd.concat([ended, frame.sort_values("poll_ts").groupby("run_id", sort=False).tail(1)])
            yield kept[~kept.index.duplicated()]

    def merge(held, frames):
        for frame in frames:
            if len(frame):
                known = held or [NEVER, *(frame[name].iloc[0].item() for name in terms)]
                held = [min(known[0], int(frame["ended"].min())), *known[1:]]
        return held

    def due_of(run, held):
        return min(held[0], held[2])

    def result(run, held):
        ended, begun, due, most = held
        return (*run, begun, due, most) if ended > due else None

    alerts = (
        seen.mapInPandas(reduced, seen.schema)
        .withWatermark("poll_ts", lateness)
        .groupBy("run_id")
        .applyInPandasWithState(
            _keeper(merge, due_of, result, ["run_id", "start", "due", "spent"], forget_seconds),
            "run_id string, start long, due long, spent double",
            "ended long, start long, due long, max_spend double, settled boolean",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return alerts.select(
        "run_id",
        F.timestamp_micros("start").alias("billing_start"),
        F.timestamp_micros("due").alias("crossed_at"),
        "spent",
    )
