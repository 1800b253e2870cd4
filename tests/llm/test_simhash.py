import random

import pytest
import xxhash

from slipway.llm import simhash
from slipway.llm.components import components


def _print(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def _roots(edges, vertices):
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in vertices}


def _brute(rows, radius=4):
    prints = [(i, _print(t)) for i, t in rows]
    edges = [
        (a, b) for a, (_, x) in enumerate(prints) for b, (_, y) in enumerate(prints[:a]) if (x ^ y).bit_count() <= radius
    ]
    roots = _roots(edges, range(len(rows)))
    least = {}
    for place, (doc_id, _) in enumerate(prints):
        root = roots[place]
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    return sorted(((i, f"{p:016x}", least.get(roots[at])) for at, (i, p) in enumerate(prints)), key=str)


def _near_copies(pick, count):
    vocabulary = [f"w{n}" for n in range(400)]
    base = [pick.choices(vocabulary, k=pick.randint(60, 400)) for _ in range(6)]
    rows = []
    for doc_id in range(count):
        words = list(pick.choice(base))
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(len(words))] = pick.choice(vocabulary)
        rows.append((doc_id + 10, " ".join(words)))
    return rows


EDGE_CASES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "É é"), (8, "word " * 20000),
    (8, "word " * 20000), (9, "\x1c x"), (None, "one"), (None, "a b c d e f"),
]


def _found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bits string, text_hash int")
    return sorted(
        ((r.doc_id, f"{r.bits % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(docs, **options).collect()),
        key=str,
    )


@pytest.mark.parametrize("chunk", [1024, 3])
def test_components_against_all_pairs(spark, chunk):
    rows = _near_copies(random.Random(5), 150) + EDGE_CASES
    assert _found(spark, rows, chunk=chunk) == _brute(rows)


def test_empty_table(spark):
    assert _found(spark, []) == []


def test_blocks_miss_no_pair_within_the_radius(spark):
    pick = random.Random(6)
    numbers = []
    for _ in range(400):
        base = pick.getrandbits(64)
        flipped = base
        for bit in pick.sample(range(64), pick.randint(0, 5)):
            flipped ^= 1 << bit
        numbers += [base, flipped]
    signed = sorted({n - (1 << 64) if n >> 63 else n for n in numbers})
    prints = spark.createDataFrame([(n,) for n in signed], "bits long")
    found = {(r.a, r.b) for r in simhash.near_links(prints, blocks=6, share=2, radius=4).collect()}
    near = {(a, b) for b in signed for a in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    assert found == near


def test_components_of_paths_stars_and_loops(spark):
    pick = random.Random(7)
    edges = [(n, n + 1) for n in range(0, 60)] + [(1000, n) for n in range(1001, 1200)] + [(5000, 5000), (7, 3)]
    edges += [tuple(pick.sample(range(2000, 2300), 2)) for _ in range(200)]
    vertices = {v for e in edges for v in e}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, components(frame).collect())) == _roots(edges, vertices)
    assert components(frame.limit(0)).collect() == []


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = sorted(map(tuple, simhash.op4_simhash(spark, sf_dir).collect()), key=str)
    assert found == _brute(rows)
