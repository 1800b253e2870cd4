"""Ranked lexical search, term at a time with a limited number of accumulators.

The documents are cut into segments that stay where they are. In a segment, each item's terms are
taken rarest first. Documents that hold a term get an accumulator, until what the remaining
terms can add at most lies below the k-th best partial score; from then on only documents that
have one are updated, exactly. A task carries its best scores from segment to segment, so later
segments open few accumulators, and hands on k documents per item.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slipway.llm.common import bounded_batches, cut, read_table, text_of

K = 10
#: Characters of items that one pass over the documents ranks for; more items take more passes.
PASS_CHARS = 4_000_000
#: Postings of a segment.
SEGMENT = 1 << 20

# Terms are made of ASCII letters and digits and all characters beyond ASCII.
_TABLE = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or chr(byte).isalnum() else 32 for byte in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """Terms in text order, with A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _passes(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(item_id, terms) in blocks of bounded size; rows of one id follow each other and are one item."""
    held, chars = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        terms = terms_of(row["text"])
        if held and held[-1][0] == row["item_id"]:
            held[-1][1].extend(terms)
        else:
            if chars > PASS_CHARS:
                yield held
                held, chars = [], 0
            held.append((row["item_id"], terms))
        chars += len(row["text"])
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def _loaded(pickled: bytes):
    return pickle.loads(pickled)


def _postings(texts: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, length, terms, counts) of every text: its terms that items ask for, by number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _loaded(vocabulary.value)
        for batch in batches:
            lengths, offsets, terms, counts = [], [0], [], []
            for value in batch.column("text").to_pylist():
                held = Counter(terms_of(value))
                lengths.append(held.total())
                asked = numbers.keys() & held.keys()
                terms.extend(numbers[term] for term in asked)
                counts.extend(held[term] for term in asked)
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(part, pa.int32())) for part in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "length", "terms", "counts"]
            )

    return texts.mapInArrow(scan, "doc_id long, length long, terms array<int>, counts array<int>")


class Ranking:
    """The best ``k`` documents of each item so far.

    ``items``: per item the numbers of its terms, how often it holds each, rarest first.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int):
        self.items, self.weights, self.documents, self.total, self.k = items, weights, documents, total, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        self.opened = 0

    def segment(self, doc_ids: np.ndarray, lengths: np.ndarray, places: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Take in documents; ``places`` says to which of them each posting belongs."""
        spread = 25 + (75 * lengths * self.documents) // self.total
        gains = (1_000_000_000 * counts) // (1000 * counts + 8 * spread[places])
        order = np.argsort(terms, kind="stable")
        terms, places, gains = terms[order], places[order], gains[order]
        edges = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        most = np.zeros(len(self.weights), dtype=np.int64)
        held = np.flatnonzero(np.diff(edges))
        if len(held):
            most[held] = np.maximum.reduceat(gains, edges[held])
        scores = np.zeros(len(doc_ids), dtype=np.int64)
        has = np.zeros(len(doc_ids), dtype=bool)
        for number, (_, asked, times) in enumerate(self.items):
            factors = self.weights[asked] * times
            bounds = np.cumsum((factors * most[asked])[::-1])[::-1]
            self._item(number, asked, factors, bounds, places, gains, edges, scores, has, doc_ids)
            scores[:], has[:] = 0, False

    def _item(self, number, asked, factors, bounds, places, gains, edges, scores, has, doc_ids) -> None:
        """One item's terms, rarest first. ``bounds``: the most that a term and those after it add."""
        kept_ids, kept_scores = self.best[number]
        floor = int(kept_scores[-1]) if len(kept_scores) == self.k else 0
        opening, open_ = True, np.empty(0, np.int64)
        for term, factor, bound in zip(asked, factors, bounds):
            at = slice(edges[term], edges[term + 1])
            if at.start == at.stop:
                continue
            holders = places[at]
            if opening:
                if len(open_) >= self.k:
                    partial = scores[open_]
                    floor = max(floor, int(np.partition(partial, -self.k)[-self.k]))
                opening = bound >= floor
            if opening:
                scores[holders] += factor * gains[at]
                fresh = holders[~has[holders]]
                has[fresh] = True
                open_ = np.concatenate([open_, fresh])
            elif not len(open_):
                return
            else:
                mine = has[holders]
                scores[holders[mine]] += factor * gains[at][mine]
        self.opened += len(open_)
        found = scores[open_]
        good = (found > 0) & (found >= floor)
        ids = np.concatenate([kept_ids, doc_ids[open_[good]]])
        found = np.concatenate([kept_scores, found[good]])
        first = np.lexsort((ids, -found))[: self.k]
        self.best[number] = ids[first], found[first]


def _ranked(postings: DataFrame, ranking, k: int) -> DataFrame:
    """(item_id, doc_id, score): of every task, the best ``k`` documents per item."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Ranking(*_loaded(ranking.value), k)
        held, size = [], 0

        def segment():
            lists = [(batch.column("terms"), batch.column("counts")) for batch in held]
            sizes = np.concatenate([np.diff(terms.offsets.to_numpy()) for terms, _ in lists])
            best.segment(
                np.concatenate([batch.column("doc_id").to_numpy() for batch in held]),
                np.concatenate([batch.column("length").to_numpy() for batch in held]),
                np.repeat(np.arange(len(sizes)), sizes),
                np.concatenate([terms.flatten().to_numpy() for terms, _ in lists]),
                np.concatenate([counts.flatten().to_numpy() for _, counts in lists]).astype(np.int64),
            )

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= SEGMENT:
                segment()
                held, size = [], 0
        if held:
            segment()
        for (item_id, _, _), (ids, scores) in zip(best.items, best.best):
            columns = [pa.array(np.full(len(ids), item_id)), pa.array(ids), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return postings.mapInArrow(rank, "item_id long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, *, k: int = K, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0.

    ``items``: item_id, text. Scores are whole numbers; of equal ones the smaller key comes
    first. Null texts have no terms. Rows of ``items`` that share an id are one item with all
    their terms; null ids and texts are no items. Rows of ``docs`` that repeat are documents
    of their own. Those without a key count in the statistics but cannot be named and are
    never listed. Extra columns are ignored; without documents or items nothing is found.

    The items are queries against all documents, in passes of bounded size: each pass goes to
    the tasks as one broadcast, writes the postings of its terms once, and moves ``k`` rows per
    item and task. Documents and postings are never shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    found = []
    for block in _passes(asked):
        found.append(cut(_search_block(spark, texts, block, k), "ranked"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.union, found)


def _search_block(spark: SparkSession, texts: DataFrame, block: list, k: int) -> DataFrame:
    words = sorted({term for _, terms in block for term in terms})
    numbers = {term: number for number, term in enumerate(words)}
    vocabulary = spark.sparkContext.broadcast(pickle.dumps(numbers))
    postings = cut(_postings(texts, vocabulary), "postings")
    totals = postings.filter("length > 0").agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    holding = np.zeros(len(words), dtype=np.int64)
    # At most one row per term of the block.
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        holding[row["term"]] = row["count"]
    weights = np.array([weight(totals["n"], int(df)) for df in holding], dtype=np.int64)
    items = []
    for item_id, terms in block:
        times = Counter(numbers[term] for term in terms)
        order = sorted(times, key=lambda number: (holding[number], number))
        items.append((item_id, np.array(order, dtype=np.int64), np.array([times[n] for n in order], dtype=np.int64)))
    ranking = spark.sparkContext.broadcast(pickle.dumps((items, weights, totals["n"], totals["total"] or 1)))
    best = _ranked(postings.filter("doc_id IS NOT NULL"), ranking, k)
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), totals AS (
    SELECT count(*) AS n, sum(len(terms))::BIGINT AS total FROM texts WHERE len(terms) > 0
), postings AS (
    SELECT doc_id, len(terms)::BIGINT AS length, unnest(terms) AS term FROM texts
), counted AS (
    SELECT doc_id, term, any_value(length) AS length, count(*) AS tf FROM postings GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM counted, totals GROUP BY term, n
), asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ) GROUP BY item_id, term
), scored AS (
    SELECT item_id, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * length * n) // total))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counted USING (term), totals
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
