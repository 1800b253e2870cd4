"""Spelling variants: words one edit apart, found by pivotal bigrams.

A word's bigrams are ordered from rare to frequent. Its prefix are the three rarest, with ties;
its pivots are two of them that do not overlap, the rarest such pair. One edit breaks one pivot
at most. So of two words one edit apart, the one whose prefix ends first in the order has a pivot
that the other holds in its prefix, moved by one place at most. The edit lies before or behind
that pivot, and what lies on its other side is equal in both words. Pivots are indexed by these
limits, prefixes look them up, and what meets is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import bounded_batches, cut, read_table, text_of

#: Least length and number of occurrences of a word, and how much more frequent a form is.
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many different runs of a document loses a character.
THINNED = 199
#: Different words of which a task holds sums at a time.
HELD_WORDS = 1 << 18

# Fixed value: runs are made of A-Z, a-z and the characters from U+00C0 to U+00FF; in Latin-1, a
# byte each, with A to Z in lower case and all others as blanks.
_TABLE = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 192 else 32 for byte in range(256)
)


def runs_of(text: str) -> list[bytes]:
    """Runs of letters in text order, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_TABLE).split()


def thinned(run: bytes, name: int) -> bytes:
    """``run``, without one character for one in 199 values of ``name``, the checksum of document and run."""
    if name % THINNED:
        return run
    at = name % len(run)
    return run[:at] + run[at + 1 :]


def _document_words(key: str, text: str) -> Iterator[tuple[bytes, int]]:
    """(word, count) of one document; a word may come more than once."""
    begun = zlib.crc32(f"{key}:".encode())
    for run, count in Counter(runs_of(text)).items():
        whole = run if run.isascii() else run.decode("latin-1").encode()
        yield thinned(run, zlib.crc32(whole, begun)), count


def word_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of whole texts, of ``LEAST_CHARS`` characters and ``LEAST_COUNT`` occurrences.

    Tasks add up their own documents, at most ``HELD_WORDS`` words at a time; the sums are merged.
    """
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def sums() -> pa.RecordBatch:
            words = pa.array([word.decode("latin-1") for word in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for word, count in _document_words(name, value):
                    if len(word) >= LEAST_CHARS:
                        held[word] = held.get(word, 0) + count
                        if len(held) >= HELD_WORDS:
                            yield sums()
                            held.clear()
        yield sums()

    keyed = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), text_of(text).alias("text"))
    found = keyed.mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= LEAST_COUNT)


def bigrams_of(word: str) -> list[str]:
    return [word[at : at + 2] for at in range(len(word) - 1)]


def prefix_of(grams: list[str], order: dict[str, int]) -> list[int]:
    """Places of the three rarest bigrams, and of all that are equal to one of them; in text order."""
    last = sorted(order[gram] for gram in grams)[2]
    return [at for at, gram in enumerate(grams) if order[gram] <= last]


def pivots_of(grams: list[str], prefix: list[int], frequency: dict[str, int], count: int = 2) -> list[int]:
    """Places of ``count`` bigrams of ``prefix`` that do not overlap, of the least summed frequency.

    ``best[picked]`` is the cheapest choice of ``picked`` bigrams that end before the current
    one begins. Three different places always hold two that do not overlap.
    """
    done: list[tuple[int, list[tuple]]] = []
    best: list[tuple | None] = [(0, ())] + [None] * count
    for at in prefix:
        while done and done[0][0] <= at - 2:
            for picked, choice in done.pop(0)[1]:
                if best[picked] is None or choice < best[picked]:
                    best[picked] = choice
        weight = frequency[grams[at]]
        new = [
            (picked + 1, (best[picked][0] + weight, (*best[picked][1], at))) for picked in range(count) if best[picked] is not None
        ]
        done.append((at, new))
    for _, new in done:
        for picked, choice in new:
            if best[picked] is None or choice < best[picked]:
                best[picked] = choice
    return list(best[count][1])


def _key(side: str, part: str, place: int, length: int) -> int:
    return xxhash.xxh64_intdigest(f"{side}:{place}:{length}:{part}", 0) - (1 << 63)


def index_keys(word: str, at: int) -> Iterator[int]:
    """Keys of a pivot at place ``at``: what a word one edit away looks like from it.

    An edit behind the pivot leaves place and head as they are, one before it leaves the tail
    and moves the place by the change of length.
    """
    size = len(word)
    for change in (-1, 0, 1):
        yield _key("head", word[: at + 2], at, size + change)
        yield _key("tail", word[at:], at + change, size + change)


def probe_keys(word: str, at: int) -> Iterator[int]:
    yield _key("head", word[: at + 2], at, len(word))
    yield _key("tail", word[at:], at, len(word))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of ``words`` (word, n) that one edit tells apart, both ways.

    An edit inserts, deletes or replaces one code point. ``words`` has one row per word, each of
    four characters or more. The frequencies of bigrams go to the driver and to the tasks: at
    most 8,100 numbers for words of the 90 characters of ``word_counts``.
    """
    spark = words.sparkSession
    bounded_batches(spark)
    grams = words.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda at: F.substring(F.col("word"), at, F.lit(2)))).alias("gram")
    )
    frequency = {row["gram"]: row["count"] for row in grams.groupBy("gram").count().toLocalIterator()}
    order = {gram: place for place, gram in enumerate(sorted(frequency, key=lambda gram: (frequency[gram], gram)))}
    shared = spark.sparkContext.broadcast((frequency, order))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, places = shared.value
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                held = bigrams_of(word)
                prefix = prefix_of(held, places)
                rows.extend((key, word, n, False) for at in prefix for key in set(probe_keys(word, at)))
                pivots = pivots_of(held, prefix, counts)
                rows.extend((key, word, n, True) for key in {key for at in pivots for key in index_keys(word, at)})
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "word", "n", "pivot"])

    keyed = cut(words.mapInArrow(keys, "key long, word string, n long, pivot boolean"), "keys")
    index = keyed.filter("pivot").select("key", "word", "n")
    probes = keyed.filter("not pivot").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = index.join(probes, "key").filter(F.levenshtein("word", "near", 1) == 1).drop("key")
    turned = met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return met.unionByName(turned).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form), by doubling the step along the chain.

    Every step multiplies the number of occurrences, so chains and rounds are few.
    """
    steps = cut(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = steps.join(ahead, "root", "left")
        if moved.filter("ahead IS NOT NULL").isEmpty():
            return steps
        steps = cut(moved.select("word", F.coalesce("ahead", "root").alias("root")), "steps")


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``word_counts``.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them, of equal
    ones the first in code-point order, if it occurs ``RATIO`` times as often as the word, else
    null; ``root`` is the last word that forms lead to, the word itself without a form. Null
    and empty texts have no words; rows that repeat count again; a null key counts as the
    empty text in the choice of thinned runs. Other columns are ignored, an empty table gives
    an empty result.
    """
    words = cut(word_counts(docs, key=key, text=text), "words")
    first = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    enough = -F.col("first.order") >= RATIO * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("first.near")).alias("form"),
        F.when(enough, -F.col("first.order")).alias("form_n"),
    )
    found = cut(found, "forms")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))
