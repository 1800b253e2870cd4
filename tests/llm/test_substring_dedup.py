import hashlib
import random
import re

import pytest

from slipway.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows, window):
    words = [WORD.findall(text or "") for _, text in rows]
    first = {}
    for (key, _), held in zip(rows, words):
        for at in range(len(held) - window + 1):
            if key is not None:
                run = tuple(held[at : at + window])
                first[run] = min(key, first.get(run, key))
    out = []
    for (key, _), held in zip(rows, words):
        gone = set()
        for at in range(len(held) - window + 1):
            if key is not None and first[tuple(held[at : at + window])] < key:
                gone.update(range(at, at + window))
        kept = " ".join(word for at, word in enumerate(held) if at not in gone)
        out.append((key, len(held), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _found(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t, 1, "r", 5) for i, t in rows], "doc_id long, text string, cells int, row string, text_hash int")
    found = substring_dedup.without_repeated_windows(docs, **settings).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in found), key=str)


def _made(seed, size, passage):
    pick = random.Random(seed)
    words = ["a", "b", "Ba", "é", " ", " x", "c,"]
    shared = [pick.choices(words, k=passage) for _ in range(6)]
    rows = []
    for number in range(size):
        held = pick.choices(words, k=pick.randint(0, 2 * passage))
        if pick.random() < 0.5:
            at = pick.randint(0, len(held))
            held[at:at] = pick.choice(shared)
        rows.append((number, pick.choice([" ", "\n", "\t ", "\x0b"]).join(held)))
    return rows


ODD = [(900, None), (901, ""), (902, "a " * 400), (903, "a " * 300), (None, "a " * 60), (None, None), (3, "b " * 70), (3, "b " * 71)]


@pytest.mark.parametrize("cells", [1, 7, 1 << 60])
def test_against_brute_force_whatever_the_sketch(spark, cells):
    rows = _made(1, 150, 12) + ODD
    rows += [rows[5], rows[5], (40, rows[6][1])]
    assert _found(spark, rows, window=6, run=3, cells=cells) == _brute(rows, 6)


def test_production_window(spark):
    rows = _made(2, 120, 70) + ODD
    expected = _brute(rows, 50)
    assert sum(row[2] for row in expected) > 1000
    assert _found(spark, rows) == expected


def test_windows_are_judged_on_the_input(spark):
    one = [f"w{n}" for n in range(60)]
    rows = [(1, " ".join(one)), (2, " ".join(["x", *one, "y"])), (3, " ".join([*one[1:], "y"]))]
    found = _found(spark, rows)
    assert [row[1:3] for row in found] == [(60, 0), (62, 60), (60, 60)] and found == _brute(rows, 50)


def test_one_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"p{n}" for n in range(55))
    rows = [(n, f"{passage} own{n}" if n % 3 == 0 else f"own{n} " * 60) for n in range(300)]
    assert _found(spark, rows) == _brute(rows, 50)


def test_empty_table(spark):
    assert _found(spark, []) == []
