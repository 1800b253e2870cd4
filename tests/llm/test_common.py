import os
import subprocess
import sys
from pathlib import Path

from slipway.llm import common

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from slipway.llm import quality, simhash
from slipway.session import build_session
spark = build_session("elsewhere", master="local[2]", spark__sql__shuffle__partitions="2")
docs = spark.createDataFrame([(1, "a b c"), (2, "A b  c")], "doc_id long, text string")
print("FOUND", sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()))
"""


def test_workers_find_the_package_wherever_the_driver_was_started(tmp_path):
    env = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    script = tmp_path / "elsewhere.py"
    script.write_text(SCRIPT.format(root=str(ROOT)))
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180
    )
    assert "FOUND [(1, 1), (2, 1)]" in done.stdout, done.stderr[-2000:]


def test_cut_tables_keep_schema_and_rows(spark):
    frame = spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS text", "array(id) AS list")
    table = common.cut(frame, "some")
    assert table.schema.simpleString() == frame.schema.simpleString() and table.count() == 5
    assert common.cut(frame.limit(0), "none").collect() == []


def test_fresh_names(spark):
    frame = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert common.fresh(frame, "a") == "a__" and common.fresh(frame, "b") == "b"


def test_sifted_rows_hold_every_value_and_the_rest_stays(spark):
    rows = spark.range(20000).selectExpr("id", "xxhash64(id) AS hash", "1 AS _bits", "2 AS _bucket")
    values = rows.filter("id % 7 = 0").select(rows.hash.alias("value"))
    may, rest = common.sifted(rows, rows.hash, values)
    assert may.columns == rest.columns == rows.columns
    held = {r.id for r in may.collect()}
    assert {i for i in range(20000) if i % 7 == 0} <= held and len(held) < 2857 + 40
    assert held | {r.id for r in rest.collect()} == set(range(20000)) and held.isdisjoint({r.id for r in rest.collect()})
    may, rest = common.sifted(rows, rows.hash, values.limit(0))
    assert may.count() == 0 and rest.count() == 20000
    nulls = spark.createDataFrame([(None,), (0,), (-1,)], "hash long")
    may, rest = common.sifted(nulls, nulls.hash, nulls.selectExpr("hash AS value"))
    assert sorted(r.hash for r in may.collect()) == [-1, 0] and [r.hash for r in rest.collect()] == [None]


def test_rows_go_by_id_and_text(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, None, 0), (None, "a", 0), (1, "a", 1)], "doc_id long, text string, _key int")
    dropped = spark.createDataFrame([(1, "a"), (2, ""), (3, "c")], "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS text_hash")
    left = common.without_rows(docs, dropped)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == [(1, "b", 0), (None, "a", 0)]
