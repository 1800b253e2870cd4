"""Benchmark passages in documents, by fingerprints of windows of an item's size.

Around every place where a document shares a shingle with an item, windows of the sizes of the
items that hold it get a SimHash. Fingerprints of items are indexed by blocks of their bits,
each entered under all values that differ in few enough bits, so that a window meets every item
within the radius under one of its own blocks. Candidates are then compared exactly, by the
weighted Jaccard similarity of their shingles. A window that passes has shingles of the item,
so a window without any need not be looked at.
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import Remembered, bounded_batches, read_table, text_of, without_rows

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which a window and an item at the similarity differ with a chance below 1 in 1000.
RADIUS = 20
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS
#: Words of items that one pass over the documents holds; more items take more passes.
PASS_WORDS = 2_000_000

#: Entries of a generation of a worker's memory of words; slots of the table that rules out most shingles.
REMEMBERED_WORDS = 1 << 17
SLOT_BITS = 20

_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def _hashes(token: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) for word in _WORDS(token))


_known = Remembered(_hashes, REMEMBERED_WORDS)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text: runs of letters and digits in lower case."""
    tokens = text.lower().split()
    known, other = _known.young, _known.other
    parts = [found if (found := known.get(token)) is not None else other(token) for token in tokens]
    return np.array(list(chain.from_iterable(parts)), dtype=np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; none if there are fewer."""
    count = len(words) - size + 1
    if count < 1 or not size:
        return np.empty(0, dtype=np.uint64)
    found = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for step in range(size):
            found = (found ^ words[step : step + count]) * np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(29)
    return found


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Plus or minus one for each bit of each hash."""
    spread = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return spread.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _neighbours(flips: int) -> list[int]:
    """Masks of a block with ``flips`` bits set at most."""
    return [sum(1 << bit for bit in chosen) for n in range(flips + 1) for chosen in combinations(range(BLOCK_BITS), n)]


class Index:
    """Items of one pass: their shingles, sizes, fingerprints and blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.counts, self.sizes, prints = [], [], [], []
        self.holders: dict[int, set[int]] = defaultdict(set)
        keys: dict[int, list[np.ndarray]] = defaultdict(list)
        for item_id, text in items:
            words = word_hashes(text)
            if not len(words):
                continue
            size = min(SHINGLE, len(words))
            hashes = shingles(words, size)
            number = len(self.ids)
            self.ids.append(item_id)
            self.sizes.append((size, len(words)))
            self.counts.append(Counter(hashes.tolist()))
            prints.append(_packed(_bits(hashes).sum(axis=0, keepdims=True))[0])
            for value in self.counts[-1]:
                self.holders[value].add(number)
            keys[size].append(hashes)
        self.prints = np.array(prints, dtype=np.uint64)
        self.known = {size: np.unique(np.concatenate(parts)) for size, parts in keys.items()}
        self.taken = {}
        for size, known in self.known.items():
            self.taken[size] = np.zeros(1 << SLOT_BITS, dtype=bool)
            self.taken[size][_slots(known)] = True
        # Two fingerprints within the radius differ in at most RADIUS // BLOCKS bits of some block.
        self.blocks = [defaultdict(list) for _ in range(BLOCKS)]
        masks = _neighbours(RADIUS // BLOCKS)
        for number, value in enumerate(self.prints.tolist()):
            for block, table in enumerate(self.blocks):
                part = value >> (block * BLOCK_BITS) & ((1 << BLOCK_BITS) - 1)
                for mask in masks:
                    table[part ^ mask].append(number)
        self.blocks = [{key: np.array(found) for key, found in table.items()} for table in self.blocks]

    def near(self, print_: int, among: np.ndarray) -> list[int]:
        """Items within the radius, of those marked in ``among``."""
        met = np.zeros(len(self.ids), dtype=bool)
        for block, table in enumerate(self.blocks):
            found = table.get(print_ >> (block * BLOCK_BITS) & ((1 << BLOCK_BITS) - 1))
            if found is not None:
                met[found] = True
        numbers = np.flatnonzero(met & among)
        return numbers[np.bitwise_count(self.prints[numbers] ^ np.uint64(print_)) <= RADIUS].tolist()

    def matches(self, text: str) -> dict[int, tuple[float, int]]:
        """Item to the greatest similarity of a window and the first word of that window."""
        best: dict[int, tuple[float, int]] = {}
        words = word_hashes(text)
        for size, known in self.known.items():
            hashes = shingles(words, size)
            seeds = np.flatnonzero(self.taken[size][_slots(hashes)])
            at = np.minimum(np.searchsorted(known, hashes[seeds]), len(known) - 1)
            seeds = seeds[known[at] == hashes[seeds]]
            if len(seeds):
                self._windows(hashes, seeds, size, best)
        return best

    def _windows(self, hashes: np.ndarray, seeds: np.ndarray, size: int, best: dict) -> None:
        """Compare windows of the sizes of the items that hold a seed, around each seed."""
        seeds_of: dict[int, set[int]] = defaultdict(set)
        items_of: dict[int, set[int]] = defaultdict(set)
        for seed, value in zip(seeds.tolist(), hashes[seeds].tolist()):
            for number in self.holders[value]:
                length = self.sizes[number][1] - size + 1
                if self.sizes[number][0] == size:
                    seeds_of[length].add(seed)
                    items_of[length].add(number)
        last = len(hashes)
        for length, places in seeds_of.items():
            among = np.zeros(len(self.ids), dtype=bool)
            among[list(items_of[length])] = True
            # Near the ends of a text a window may lack some of its words.
            for begin, end in _merged(sorted(places), length, last):
                sums = np.concatenate([np.zeros((1, 64), np.int32), _bits(hashes[begin:end]).cumsum(axis=0, dtype=np.int32)])
                span = min(length, end - begin)
                prints = _packed(sums[span:] - sums[:-span]).tolist()
                for start, print_ in enumerate(prints, begin):
                    candidates = self.near(print_, among)
                    if candidates:
                        window = Counter(hashes[start : start + span].tolist())
                        for number in candidates:
                            found = _similarity(window, self.counts[number])
                            if found >= SIMILARITY and found > best.get(self.ids[number], (0.0, 0))[0]:
                                best[self.ids[number]] = (found, start)


def _merged(places: list[int], length: int, last: int) -> Iterator[tuple[int, int]]:
    """Ranges of shingles that windows of ``length`` holding one of ``places`` cover."""
    begin = end = None
    for place in places:
        low, high = max(0, place - length + 1), min(last, place + length)
        if begin is not None and low <= end:
            end = max(end, high)
        else:
            if begin is not None:
                yield begin, end
            begin, end = low, high
    if begin is not None:
        yield begin, end


def _similarity(one: Counter, other: Counter) -> float:
    """Weighted Jaccard: shared occurrences over all."""
    shared = sum(min(count, other[value]) for value, count in one.items() if value in other)
    return shared / (sum(one.values()) + sum(other.values()) - shared)


@functools.lru_cache(maxsize=2)
def _index(items: bytes) -> Index:
    return Index(pickle.loads(items))


def _passes(benchmark: DataFrame) -> Iterator[bytes]:
    """Items in blocks of a bounded number of words, for one pass over the documents each."""
    held, words = [], 0
    for row in benchmark.toLocalIterator():
        size = len(row["text"]) // 2 + 1
        if held and words + size > PASS_WORDS:
            yield pickle.dumps(held)
            held, words = [], 0
        held.append((row["item_id"], row["text"]))
        words += size
    if held:
        yield pickle.dumps(held)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word): documents and the items they hold a passage of.

    ``benchmark``: item_id, text. Words are runs of letters and digits in lower case. A document
    matches an item if a window of the item's number of words reaches a weighted Jaccard
    similarity of 0.8 over shingles of five words; items of fewer words are one shingle. Null and
    empty texts, items without words and null keys of items match nothing; documents that repeat,
    or have a null key, match row by row. Extra columns are ignored.

    The benchmark is a query set against all documents, in blocks: each block is a broadcast
    of bounded size and one more scan of the documents, which are never shuffled.
    """
    return _matches(docs, benchmark, key, text).drop("text_hash")


def _matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """The matches with ``text_hash``, xxhash64 of the document's text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    schema = "doc_id long, item_id long, similarity double, first_word long, text_hash long"
    found = spark.createDataFrame([], schema)
    for block in _passes(items):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for batch in batches:
                rows = [
                    (doc_id, item_id, similarity, place, text_hash)
                    for doc_id, value, text_hash in zip(*(column.to_pylist() for column in batch.columns))
                    for item_id, (similarity, place) in index.matches(value).items()
                ]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(columns, kinds)],
                    ["doc_id", "item_id", "similarity", "first_word", "text_hash"],
                )
            _known.clear()  # the worker is kept for tasks of other operators

        found = found.union(texts.mapInArrow(scan, schema))
    return found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, without documents that match an item; null keys stay.

    A document is named by key and text, so that others with the same key stay. ``docs`` is read
    more than once and should be a table; only rows that may be named are shuffled.
    """
    return without_rows(docs, _matches(docs, benchmark, key, text), key=key, text=text)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
