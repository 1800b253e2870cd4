"""Repeated passages of fifty words, found exactly behind a count-min sketch.

The first pass counts documents in the cells of a sketch. The cell of a window of fifty words
is the least hash of the runs of 25 words in it, so equal windows share a cell, neighbouring
windows mostly do too, and a document adds to about one cell for every 13 words. Each task sums
the cells of its own documents and the sums are merged by cell; a cell's sum is never less than
the number of documents of any window in it. The second pass groups exactly, by 128-bit hashes,
only the windows whose cell counts two documents or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import bounded_batches, cut, read_table, sifted, text_of

WINDOW = 50
#: Words of the runs whose least hash names a window's cell.
RUN = 25
#: Cells of the sketch. It is kept as a table of the cells that are not zero, spread by cell.
CELLS = 1 << 60

_digest = xxhash.xxh3_128_digest
#: Odd factors of the two polynomial hashes of a run of words.
_FACTORS = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB43)


def words_of(text: str) -> list[bytes]:
    """Words between white space of ASCII, unchanged."""
    return text.encode("utf-8", "surrogatepass").split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes per word, a row each."""
    return np.frombuffer(b"".join(map(_digest, words)), dtype="<u8").reshape(-1, 2)


def _rolling(values: np.ndarray, factor: int, size: int) -> np.ndarray:
    """sum(values[i + j] * factor ** j) over j < size, modulo 2 ** 64, for every run of ``size`` values."""
    powers = np.full(len(values), factor, dtype=np.uint64)
    powers[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(powers), dtype=np.uint64)])
    powers[1:] = pow(factor, -1, 1 << 64)
    return (sums[size:] - sums[:-size]) * np.cumprod(powers)[: len(values) - size + 1]


def _mixed(values: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers, after which every bit depends on all."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(32))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, by doubling."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _cells(hashes: np.ndarray, window: int, run: int, cells: int) -> np.ndarray:
    """The cell of every window."""
    runs = _mixed(_rolling(hashes[:, 0], _FACTORS[0], run))
    return (_least(runs, window - run + 1) % np.uint64(cells)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(part) for part in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text")
    )


def _row() -> Column:
    return F.xxhash64("doc_id", "text_hash")


def repeated_windows(
    docs: DataFrame,
    *,
    window: int = WINDOW,
    run: int = RUN,
    cells: int = CELLS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, starts): of rows with repeats, where windows start that go.

    A window goes if its ``window`` words also start in a document with a smaller key. Words
    are compared unchanged; windows are judged on the input. ``text_hash`` is xxhash64 of the
    text, so that rows that share a key are told apart. Rows without a key and texts of fewer
    words have no part in it. ``run`` must be smaller than ``window``.

    What is shuffled: the cells, once to be counted; (row, cell) of cells that may count two;
    texts that hold such a cell; and their windows of such cells, as hashes. A cell or window
    that a third of all documents share is counted by partial sums, and joined as a skewed key
    with a table that has it once. Starts are gathered per row, at most one per word of it.
    """
    bounded_batches(docs.sparkSession)
    named = _named(docs.filter(F.col(key).isNotNull()), key, text)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for row, value in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(value)
                if len(words) >= window:
                    rows.append(row)
                    parts.append(np.unique(_cells(_word_hashes(words), window, run, cells)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), _lists(parts)], ["row", "cells"])

    held = cut(named.select(_row().alias("row"), "text").mapInArrow(sketch, "row long, cells array<bigint>"), "cells")
    held = held.select("row", F.explode("cells").alias("cell"))
    counts = held.groupBy("cell").count()
    repeated = cut(counts.filter("count > 1").select(F.col("cell").alias("value")), "repeated")
    may, _ = sifted(held, F.col("cell"), repeated)
    met = may.join(repeated.withColumnRenamed("value", "cell").hint("merge"), "cell")
    suspects = cut(met.groupBy("row").agg(F.collect_set("cell").alias("cells")), "suspects")

    texts, _ = sifted(named.withColumn("row", _row()), F.col("row"), suspects.select(F.col("row").alias("value")))
    texts = texts.join(suspects.hint("merge"), "row").select("doc_id", "text_hash", "text", "cells")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("doc_id", "text_hash", "text"))
            for doc_id, text_hash, value, listed in zip(*columns, batch.column("cells")):
                hashes = _word_hashes(words_of(value))
                starts = np.flatnonzero(np.isin(_cells(hashes, window, run, cells), listed.values.to_numpy()))
                found = [_rolling(hashes[:, lane], _FACTORS[lane], window)[starts].view(np.int64) for lane in (0, 1)]
                names = [np.full(len(starts), name, dtype=np.int64) for name in (doc_id, text_hash)]
                columns_out = [*names, starts.astype(np.int32), *found]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns_out], ["doc_id", "text_hash", "start", "one", "other"])

    found = texts.mapInArrow(windows, "doc_id long, text_hash long, start int, one long, other long")
    found = cut(found, "windows")
    same = ["one", "other"]
    firsts = found.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = cut(firsts.filter("first < last").drop("last"), "firsts")
    later = found.join(firsts, same).filter("doc_id > first")
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def kept_words(words: list[bytes], starts: np.ndarray, window: int = WINDOW) -> list[bytes]:
    """``words`` without those that a window at one of ``starts`` covers."""
    change = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return [words[place] for place in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def without_repeated_windows(
    docs: DataFrame, *, window: int = WINDOW, run: int = RUN, cells: int = CELLS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row with its words that stay, joined by one space.

    ``kept`` is binary, the UTF-8 of the words. A null text has no words; a row without a key
    keeps all of its words; rows that repeat come out repeated. Other columns are ignored, an
    empty table gives an empty result. Only texts that may lose words are shuffled.
    """
    removed = cut(repeated_windows(docs, window=window, run=run, cells=cells, key=key, text=text), "removed")
    named = _named(docs, key, text)
    value = removed.select(_row().alias("value"))
    may, rest = sifted(named, _row(), value)
    met = may.join(removed.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts")
    rest = rest.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, kept = [], [], []
            for value, starts in zip(batch.column("text").to_pylist(), batch.column("starts")):
                words = words_of(value)
                left = kept_words(words, starts.values.to_numpy(), window) if starts.is_valid else words
                totals.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            columns = [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return met.unionByName(rest).mapInArrow(cleaned, "doc_id long, n_words long, n_removed long, kept binary")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated_windows(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, start, md5(array_to_string(list_slice(words, start, start + 49), ' ')) AS passage
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS start FROM texts)
), later AS (
    SELECT doc_id, start FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY passage)
), places AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), marked AS (
    SELECT places.doc_id, place, word,
           place - max(later.start) OVER (PARTITION BY places.doc_id ORDER BY place) < 50 AS gone
    FROM places LEFT JOIN later ON later.doc_id = places.doc_id AND later.start = place
), kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
           string_agg(word, ' ' ORDER BY place) FILTER (gone IS NOT TRUE) AS kept
    FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
