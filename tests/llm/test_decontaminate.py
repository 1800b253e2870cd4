import random
from collections import Counter

import pytest

from slipway.llm import decontaminate as D

VOCABULARY = [f"word{n}" for n in range(500)] + ["a", "b", "c"]


def _grams(words):
    size = min(D.SHINGLE, len(words))
    return size, Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def _brute(docs, items):
    """Every window of every item's size, by shingles as tuples of words."""
    out = set()
    for doc_id, text in docs:
        words = D._WORDS((text or "").lower())
        for item_id, item in items:
            wanted = D._WORDS((item or "").lower())
            if item_id is None or not wanted:
                continue
            size, counts = _grams(wanted)
            count = min(len(wanted), len(words))
            for start in range(max(0, len(words) - count) + 1):
                window = words[start : start + count]
                found = Counter(tuple(window[i : i + size]) for i in range(len(window) - size + 1))
                shared = sum((found & counts).values())
                if found and shared / (sum(found.values()) + sum(counts.values()) - shared) >= 0.8:
                    out.add((doc_id, item_id))
    return out


def _data(seed):
    pick = random.Random(seed)
    items = [(n, " ".join(pick.choices(VOCABULARY, k=pick.randint(5, 60)))) for n in range(30)]
    items += [(50, "Short, item"), (51, "one"), (52, ""), (53, None), (54, "echo " * 12), (55, "?!")]
    docs = []
    for doc_id in range(120):
        words = pick.choices(VOCABULARY, k=pick.randint(0, 150))
        if doc_id % 2:
            passage = (pick.choice(items[:30])[1]).split()
            for _ in range(pick.choice([0, 0, 1, 2, 4])):
                at = pick.randrange(len(passage))
                passage[at : at + 1] = pick.choice([[], ["new"], ["NEW", "two"]])
            at = pick.randint(0, len(words))
            words[at:at] = [word.upper() + "," for word in passage]
        docs.append((doc_id, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "it is a short item."), (903, "echo " * 500), (904, "one"), (None, items[0][1]), (905, items[3][1]), (905, items[3][1]), (906, "x " * 100000 + items[4][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, monkeypatch, seed):
    docs, items = _data(seed)
    monkeypatch.setattr(D, "PASS_WORDS", 200)
    frame = spark.createDataFrame([(i, t, "x", 2.0) for i, t in docs], "doc_id long, text string, item_id string, similarity double")
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = D.benchmark_matches(frame, benchmark).collect()
    short = [(i, t) for i, t in docs if len(t or "") < 10**5]
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id != 906} == _brute(short, items)
    assert (906, 4) in {(r.doc_id, r.item_id) for r in found}
    assert sum(r.doc_id == 905 for r in found) == 2 and all(0.8 <= r.similarity <= 1 for r in found)


def test_filter_keeps_clean_rows_and_columns(spark):
    docs, items = _data(3)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _matched string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = D.without_benchmark(frame, benchmark)
    assert kept.columns == frame.columns
    dirty = {i for i, _ in _brute([d for d in docs if len(d[1] or "") < 10**5], items)} | {906}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in docs if i is None or i not in dirty)
    assert D.benchmark_matches(frame.limit(0), benchmark).collect() == []
    assert D.benchmark_matches(frame, benchmark.limit(0)).collect() == []


def test_a_clean_document_does_not_go_with_its_namesake(spark):
    passage = " ".join(random.Random(5).choices(VOCABULARY, k=30))
    rows = [(5, passage), (5, "other words here"), (6, passage), (6, passage), (7, None), (None, passage)]
    benchmark = spark.createDataFrame([(1, passage), (1, passage)], "item_id long, text string")
    for kind in ("int", "long"):
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        kept = D.without_benchmark(docs, benchmark)
        assert kept.dtypes == docs.dtypes
        assert Counter(map(tuple, kept.collect())) == Counter([rows[1], rows[4], rows[5]])


def test_blocks_meet_every_item_within_the_radius():
    pick = random.Random(4)
    index = D.Index([(n, " ".join(pick.choices(VOCABULARY, k=30))) for n in range(60)])
    for number, print_ in enumerate(index.prints.tolist()):
        for flips in range(D.RADIUS + 1):
            changed = print_
            for bit in pick.sample(range(64), flips):
                changed ^= 1 << bit
            among = index.prints == index.prints[number]
            assert index.near(changed, among) == [number]


def test_query_finds_whole_items(spark, sf_dir):
    found = {(r.doc_id, r.item_id) for r in D.op5_decontamination(spark, sf_dir).collect()}
    docs = [(r.doc_id, " ".join(["", *D._WORDS((r.text or "").lower()), ""])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, " ".join(["", *D._WORDS((r.text or "").lower()), ""])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {(d, i) for d, text in docs for i, item in items if item in text} <= found
