import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from compare import duck

from slipway.llm import spelling


def _counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 6 and n >= 5}


def _brute(rows):
    """Words that share a word with one character left out, at one place, are at most one edit apart."""
    words = _counts(rows)
    near = defaultdict(set)
    met = defaultdict(set)
    for word in words:
        for at in range(len(word)):
            met["cut", word[:at] + word[at + 1 :]].add(word)
            met["swap", at, word[:at] + word[at + 1 :]].add(word)
    for key, group in met.items():
        if key[0] == "swap":
            for one, other in itertools.permutations(group, 2):
                near[one].add(other)
        elif key[1] in words:
            for word in group:
                near[word].add(key[1])
                near[key[1]].add(word)
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda other: (-words[other], other), default=None)
        form[word] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, n, len(near[word]), form[word], words.get(form[word]), root))
    return sorted(out)


def _found(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(docs).collect())


def _made():
    pick = random.Random(3)
    letters = "abcé"
    base = ["".join(pick.choices(letters, k=pick.randint(6, 9))) for _ in range(60)]
    rows = []
    for number in range(1500):
        words = []
        for word in pick.choices(base, [1 / (n + 1) for n in range(60)], k=20):
            if pick.random() < 0.2:
                at = pick.randrange(len(word) + 1)
                word = word[:at] + pick.choice(["", *letters]) + word[at + pick.randint(0, 1) :]
            words.append(pick.choice([word, word.upper(), word]))
        rows.append((number, pick.choice([" ", ", ", "1", "日"]).join(words)))
    return rows


def test_against_brute_force(spark):
    rows = _made()
    rows += [(2000, None), (2001, ""), (None, "abcabc " * 9), (2002, "aaaaaaa " * 3000 + "aaaaaa " * 10 + "aaaaaaaa " * 10), rows[4], rows[4]]
    rows += [(2004, "quince " * 5 + "quinze " * 25 + "quinzes " * 125)]
    rows += [(2003, "À×÷ÿßÀ " * 40 + "À×÷ÿßa " * 5)]
    expected = _brute(rows)
    assert sum(row[2] for row in expected) > 200 and any(row[3] for row in expected)
    assert any(row[5] != row[3] and row[3] for row in expected)
    assert _found(spark, rows) == expected


def test_equal_counts_take_the_first_form(spark):
    rows = [(1, "abcdef " * 5 + "abcdeg " * 50 + "abcdea " * 50)]
    assert [row[:6] for row in _found(spark, rows) if row[0] == "abcdef"] == [("abcdef", 5, 2, "abcdea", 50, "abcdea")]


def test_nothing(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(1, None), (2, "short")]) == []


def test_query_against_brute_force(spark, sf_dir):
    rows = duck(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall()
    found = spelling.op13_spelling(spark, sf_dir).collect()
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found) == _brute(rows)


def test_pivots_are_rarest_and_apart():
    pick = random.Random(9)
    for _ in range(500):
        word = "".join(pick.choices("abc", k=pick.randint(4, 12)))
        grams = spelling.bigrams_of(word)
        frequency = {gram: pick.randint(1, 9) for gram in set(grams)}
        order = {gram: place for place, gram in enumerate(sorted(frequency, key=lambda gram: (frequency[gram], gram)))}
        prefix = spelling.prefix_of(grams, order)
        pivots = spelling.pivots_of(grams, prefix, frequency)
        choices = [(frequency[grams[a]] + frequency[grams[b]], (a, b)) for a, b in itertools.combinations(prefix, 2) if b - a > 1]
        assert tuple(pivots) == min(choices)[1]
