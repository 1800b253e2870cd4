import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from slipway.llm import sharding


def _hash_of(seed, turn, value):
    """Spark's hash of (int, int, long)."""
    state = 42
    for part in (seed, turn):
        state = xxhash.xxh64_intdigest((part % (1 << 32)).to_bytes(4, "little"), state)
    state = xxhash.xxh64_intdigest((value % (1 << 64)).to_bytes(8, "little"), state)
    return state - (1 << 64) if state >> 63 else state


def _place(number, rows, seed):
    a, b = sharding.grid(rows)
    while True:
        left, right = divmod(number, b)
        for turn in range(sharding.ROUNDS):
            if turn % 2 == 0:
                left = (left + _hash_of(seed, turn, right) % a) % a
            else:
                right = (right + _hash_of(seed, turn, left) % b) % b
        number = left * b + right
        if number < rows:
            return number


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 24, 101, 1000, 4097])
def test_permutation_is_a_bijection_that_anyone_can_compute(spark, rows):
    for seed in (0, 7):
        found = spark.range(rows).select("id", sharding.permuted(F.col("id"), rows, seed).alias("place")).collect()
        assert sorted(r.place for r in found) == list(range(rows))
        assert all(r.place == _place(r.id, rows, seed) for r in found[:200])


def test_places_are_spread(spark):
    rows = 20000
    found = spark.range(rows).select("id", sharding.permuted(F.col("id"), rows).alias("place")).collect()
    bins = Counter((r.id * 10 // rows, r.place * 10 // rows) for r in found)
    assert len(bins) == 100 and max(abs(n - 200) for n in bins.values()) < 75


def _plan(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, shard int, _bin string")
    return sharding.shard_plan(docs, **options)


def test_shards_differ_by_one_row_and_slots_have_no_gap(spark):
    pick = random.Random(3)
    rows = [(i, pick.choice([None, "", "é漢", "x" * 100000, "same"])) for i in range(997)]
    rows += [(5, "same")] * 3 + [(None, "a"), (None, None)]
    found = _plan(spark, rows).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, count in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(count))


def test_same_shards_for_any_partitioning(spark):
    rows = [(i, f"text {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(sharding.shard_plan(docs.repartition(1)).collect())
    assert first == sorted(sharding.shard_plan(docs.repartition(13, "text")).collect())
    assert first != sorted(sharding.shard_plan(docs, seed=1).collect())


def test_empty_table(spark):
    assert _plan(spark, []).collect() == []


def test_query_covers_the_table_without_python(spark, sf_dir):
    found = sharding.op6_sharding(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = found.collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
