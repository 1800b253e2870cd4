import random

from slipway.llm import line_dedup


def _brute(rows):
    """rows: (doc_id, text) by unique id."""
    seen, gone = set(), {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        full = [(at, line.strip(" ")) for at, line in enumerate((text or "").split("\n")) if line.strip(" ")]
        for start in range(len(full) - 2):
            run = full[start : start + 3]
            passage = tuple(line for _, line in run)
            if passage in seen:
                gone.setdefault(doc_id, set()).update(at for at, _ in run)
            seen.add(passage)
    out = []
    for doc_id, text in rows:
        lines = [] if text is None else text.split("\n")
        cut = gone.get(doc_id, set())
        left = None if text is None else "\n".join(line for at, line in enumerate(lines) if at not in cut)
        out.append((doc_id, len(lines), len(cut), left))
    return sorted(out, key=str)


def _cleaned(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 3, 9) for i, t in rows], "doc_id long, text string, _key string, removed int, n_lines int")
    found = line_dedup.without_repeated_lines(docs)
    assert {"_key", "removed"} <= set(found.columns)
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in found.collect()), key=str)


def test_against_brute_force(spark):
    pick = random.Random(4)
    rows = []
    for doc_id in range(300):
        lines = pick.choices(["a", "b", " a ", "", "c", "d" * 2000, "é", " ", "\tx"], k=pick.randint(0, 12))
        rows.append((doc_id, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "a\na\na\na\na"), (903, "\n".join(f"l{n}" for n in range(3000))), (904, "\n".join(f"l{n}" for n in range(3000))), (None, "a\nb\nc")]
    assert _cleaned(spark, rows) == _brute(rows)


def test_first_of_repeated_passages_stays(spark):
    passage = "one\ntwo\nthree\nfour"
    found = _cleaned(spark, [(1, "start\n" + passage), (2, passage + "\n\nend"), (3, "one\ntwo")])
    assert found == [(1, 5, 0, "start\n" + passage), (2, 6, 4, "\nend"), (3, 2, 0, "one\ntwo")]


def test_empty_table(spark):
    assert _cleaned(spark, []) == []


def test_main_path_has_no_python(spark, sf_dir):
    plan = line_dedup.op10_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
