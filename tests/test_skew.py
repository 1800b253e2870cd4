"""One key holding a third of all rows: right results, and no task that gets them all."""

import random
from contextlib import contextmanager
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slipway import schemas as S
from slipway.functions.joins import lookup_join, top_k
from slipway.operators import settings, sizing, telemetry


@contextmanager
def configured(spark, changes):
    before = {key: spark.conf.get(key, None) for key in changes}
    for key, value in changes.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shuffled(spark, partitions=32):
    """Joins by shuffle only, and shuffle partitions as they are."""
    return configured(
        spark,
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": str(partitions),
        },
    )


def hot(number):
    return "hot" if number % 3 == 0 else f"k{number % 997}"


@pytest.fixture()
def facts(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    return spark.range(30_000, numPartitions=8).select("id", key.alias("key"))


def _largest_share(df):
    counts = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
    return max(r["count"] for r in counts) / sum(r["count"] for r in counts)


def test_lookup_join_spreads_a_hot_key(spark, facts):
    names = spark.createDataFrame([(f"k{i}", i) for i in range(0, 997, 2)] + [("hot", -1)], "key string, value int")
    with shuffled(spark):
        joined = lookup_join(facts, names, ["key"], ["id"])
        plain = facts.join(names, "key", "left")
        # The same rows as a plain join, without the task that takes a third of them.
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        assert _largest_share(plain) > 0.33
        assert _largest_share(joined) < 0.15


def test_lookup_join_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, key string")
    right = spark.createDataFrame([("a", 9), (None, 8)], "key string, value int")
    for salts in (1, 16):
        found = lookup_join(left, right, ["key"], ["id"], salts=salts).select("id", "value").collect()
        assert {tuple(r) for r in found} == {(1, None), (2, 9), (3, None)}
        inner = lookup_join(left, right, ["key"], ["id"], how="inner", salts=salts).collect()
        assert [r.id for r in inner] == [2]


@pytest.mark.parametrize("salt_by", [None, ["id"]])
def test_top_k_of_a_hot_group(spark, facts, salt_by):
    with shuffled(spark):
        best = top_k(facts, ["key"], [F.col("id").desc()], 3, salt_by=salt_by)
        plan = best._jdf.queryExecution().executedPlan().toString()
        found = {}
        for row in best.collect():
            found.setdefault(row.key, {})[row["rank"]] = row.id
    assert "WindowGroupLimit" in plan and "Partial" in plan
    expected = {}
    for number in range(30_000):
        expected.setdefault(hot(number), []).append(number)
    assert found == {
        key: dict(enumerate(sorted(numbers, reverse=True)[:3], 1)) for key, numbers in expected.items()
    }


def test_sizes_and_counts(spark, facts):
    files = facts.select(
        F.col("key").alias("model_id"),
        F.when(F.col("id") % 5 == 0, "optimizer.bin").otherwise("w.Safetensors").alias("file_name"),
        (F.col("id") * 2**20).alias("size_bytes"),
    )
    counts = facts.select(
        F.col("key").alias("model_id"),
        F.when(F.col("id") % 2 == 0, "F4").otherwise("bf16").alias("dtype"),
        F.col("id").alias("param_count"),
    )
    with shuffled(spark):
        sizes = {r.model_id: r.size_gb for r in sizing.weight_file_rollup(files).collect()}
        params = {r.model_id: (r.param_count, r.weight_bytes) for r in sizing.param_rollup(counts).collect()}
    for key in ("hot", "k1", "k500"):
        numbers = [n for n in range(30_000) if hot(n) == key]
        assert sizes[key] == sum(n for n in numbers if n % 5) * 2**20 / 2**30
        halves = sum(n * (1 if n % 2 == 0 else 4) for n in numbers)
        assert params[key] == (sum(numbers), halves // 2)


def test_settings(spark):
    draw = random.Random(4)
    keys = ["model_id", "vram_gb", "command", "provider"]
    rows = [
        (hot(i) if i % 3 == 0 else f"r{draw.randrange(40)}", draw.randrange(4), i, draw.choice(keys), draw.choice([None, "1", "22", "9", ""]))
        for i in range(6000)
    ]
    with shuffled(spark):
        frame = settings.overlay_settings(spark.createDataFrame(rows, S.SETTINGS_ROWS).repartition(8))
        found = {r.run_id: r for r in frame.collect()}
    for run in {r[0] for r in rows}:
        for key in keys:
            given = [(layer, seq, value) for r, layer, seq, k, value in rows if (r, k) == (run, key) and value is not None]
            if given and key != "vram_gb":
                assert found[run][key] == max(given)[2]


def test_readiness_of_a_pod_with_very_many_snapshots(spark):
    start = datetime(2024, 5, 1)
    ready = '{"status": "ACTIVE", "sshConnection": "h"}'
    rows = [
        (hot(i), "primeintellect", start + timedelta(milliseconds=i), ready if i in (1500, 1501, 2002, 2999) else "{}")
        for i in range(3000)
    ]
    with shuffled(spark):
        frame = spark.createDataFrame(rows, S.POD_SNAPSHOTS).repartition(8)
        found = {r.pod_id: r.state for r in telemetry.pod_readiness(frame).collect()}
    expected = {hot(i): "pending" for i in range(3000)}
    expected.update({hot(i): "ready" for i in (1500, 1501, 2002, 2999)})
    assert found == expected


def test_adaptive_execution_splits_the_salted_parts_further(spark):
    """Thresholds as small as the data; on a cluster they are hundreds of megabytes."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    }
    run = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.xxhash64("id") % 20000))
    polls = spark.range(600_000, numPartitions=16).select(
        run.alias("run_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") / 50).alias("poll_ts"),
        F.when(F.col("id") % 9991 == 5, "done:0").otherwise("running").alias("raw_status"),
    )
    runs = polls.groupBy("run_id").agg(F.min("poll_ts").alias("billing_start")).select(
        "run_id", F.lit("p").alias("pod_id"), F.lit("g").alias("gpu_type_id"), "billing_start",
        F.lit(0.5).alias("hourly"), F.lit(1.0).alias("max_spend"), F.lit(True).alias("keep_pod_on_success"),
    )
    with configured(spark, small):
        results, splits = [], []
        for salts in (1, 4):
            ended = telemetry.run_outcome(polls, runs, salts=salts).select("run_id", "outcome", "spent")
            results.append(sorted(map(tuple, ended.collect()), key=str))
            splits.append("skew=true" in ended._jdf.queryExecution().executedPlan().toString())
    assert results[0] == results[1]
    assert splits == [False, True]
