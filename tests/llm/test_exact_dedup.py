import hashlib
from collections import defaultdict

from slipway.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, _text int, count int"


def _expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        same = groups[text or ""]
        keep = max((i for i in same if i is not None), default=None)
        out.append((doc_id, keep, len(same), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def test_groups_against_brute_force(spark):
    head = "a" * exact_dedup.HEAD_CHARS
    rows = [
        (1, None), (2, ""), (3, ""), (4, "é"), (5, "e"), (6, "e"), (7, "e "), (8, head + "x"), (9, head + "y"),
        (10, head + "x"), (11, "long " * 50000), (12, "long " * 50000), (13, "alone"), (14, "E"), (6, "e"),
        (None, "no key"), (None, "é"),
    ]
    found = exact_dedup.exact_duplicates(_frame(spark, rows), digest=True)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_hash", "text_sha256"]
    assert sorted(map(tuple, found.drop("text_hash").collect()), key=str) == _expected(rows)


def test_empty_table_and_null_keys(spark):
    assert exact_dedup.exact_duplicates(_frame(spark, []), digest=True).collect() == []
    rows = exact_dedup.exact_duplicates(_frame(spark, [(None, "a"), (None, "a")])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in rows] == [(None, 2, True)] * 2


def test_one_of_each_text_stays_with_its_columns(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "a")]
    left = exact_dedup.without_duplicates(_frame(spark, rows))
    assert left.columns == ["doc_id", "text", "keep_id", "_text", "count"]
    assert sorted((r.doc_id or 0, r.text, r.keep_id) for r in left.collect()) == [(0, "a", "x"), (2, "a", "x"), (4, "", "x"), (5, "b", "x")]


def test_of_rows_with_one_id_only_the_copy_goes(spark):
    rows = [(5, "a"), (6, "a"), (5, "b"), (5, "a")]
    left = exact_dedup.without_duplicates(_frame(spark, rows))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(5, "b"), (6, "a")]


def test_a_large_group_is_split(spark):
    """Half the rows are copies: their rows come from more tasks than one in the join with the groups."""
    rows = [(i, "same" if i % 2 else f"text {i}") for i in range(4000)]
    found = exact_dedup.exact_duplicates(_frame(spark, rows).repartition(8))
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in joins and "Aggregate" not in joins.split("Union")[1].split("Join LeftOuter")[0]


def test_main_path_has_no_python(spark, sf_dir):
    plan = exact_dedup.op8_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
