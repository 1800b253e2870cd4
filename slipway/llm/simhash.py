"""Near duplicates by SimHash fingerprints joined on blocks of their bits.

Fingerprints that differ in at most r bits agree in at least n - r of n blocks, so two such
fingerprints meet under the key of at least one choice of n - r blocks. Copies with the same
fingerprint are one before any key is made. Within a key, fingerprints are compared in chunks
of bounded size, and a chunk reports a spanning forest of its links instead of all of them:
the components are the same, and a dense key gives rows in proportion to its members times
its chunks, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import bounded_batches, cut, read_table, text_of
from slipway.llm.components import components

BITS = 64
SEED = 42
#: Most fingerprints of one key that a task compares with each other at a time.
CHUNK = 1024

_hash = xxhash.xxh64_intdigest


def words_of(text: str) -> list[bytes]:
    """Words between white space of ASCII, with A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, of all words if there are fewer, in text order."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([_hash(line, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([_hash(line[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> bytes:
    """The bits set in over half the hashes, the lowest first."""
    if not len(hashes):
        return bytes(8)
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[start : start + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, *, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, bits): xxhash64 of the text and the SimHash of its shingles, both long.

    Shingles count as often as they occur. Texts without words, null ones too, have no bit set.
    """
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority_bits(shingle_hashes(words_of(value), shingle)) for value in batch.column("text").to_pylist()]
            bits = pa.array(np.frombuffer(b"".join(found), dtype="<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), bits], ["doc_id", "text_hash", "bits"]
            )

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text")
    )
    return rows.mapInArrow(scan, "doc_id long, text_hash long, bits long")


def _block_keys(blocks: int, share: int):
    """One key per choice of blocks: the choice's number above, a hash of its bits below."""
    edges = [BITS * place // blocks for place in range(blocks + 1)]
    keys = []
    for number, choice in enumerate(combinations(range(blocks), share)):
        mask = sum(((1 << (edges[place + 1] - edges[place])) - 1) << edges[place] for place in choice)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.xxhash64(F.lit(number), F.col("bits").bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def _forest(numbers: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """Rows (a, b) of a spanning forest of the pairs whose bits differ in ``radius`` at most."""
    links = []
    reached = np.zeros(len(numbers), dtype=bool)
    for begin in range(len(numbers)):
        if reached[begin]:
            continue
        reached[begin] = True
        queue = [begin]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(~reached)
            if not len(rest):
                break
            near = rest[np.bitwise_count(words[rest] ^ words[at]) <= radius]
            reached[near] = True
            links.append(np.column_stack([np.full(len(near), numbers[at]), numbers[near]]))
            queue.extend(near.tolist())
    return np.concatenate(links) if links else np.empty((0, 2), dtype=np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bits, starts, stops) of whole runs of a chunk; rows come sorted by chunk. A run may span batches."""

    def whole(chunk: np.ndarray, bits: np.ndarray):
        edges = np.flatnonzero(chunk[1:] != chunk[:-1]) + 1
        return bits, np.r_[0, edges], np.r_[edges, len(chunk)]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("chunk").to_numpy(), batch.column("bits").to_numpy()
        if held is not None:
            rows = tuple(np.concatenate(parts) for parts in zip(held, rows))
        earlier = np.flatnonzero(rows[0] != rows[0][-1])
        end = int(earlier[-1]) + 1 if len(earlier) else 0
        if end:
            yield whole(*(part[:end] for part in rows))
        held = tuple(part[end:] for part in rows)
    if held is not None:
        yield whole(*held)


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within each chunk."""
    for bits, starts, stops in _runs(batches):
        words = bits.view(np.uint64)
        # Pairs, by far the most, all at once; larger runs one by one.
        pairs = starts[stops - starts == 2]
        near = pairs[np.bitwise_count(words[pairs] ^ words[pairs + 1]) <= radius]
        found = [np.column_stack([bits[near], bits[near + 1]])]
        for start, stop in zip(starts, stops):
            if stop - start > 2:
                found.append(_forest(bits[start:stop], words[start:stop], radius))
        links = np.concatenate(found)
        low, high = np.minimum(links[:, 0], links[:, 1]), np.maximum(links[:, 0], links[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])


def near_links(prints: DataFrame, *, blocks: int, share: int, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect what pairs within ``radius`` connect, over distinct prints (bits long).

    Candidates agree in ``share`` of ``blocks`` blocks; with share = blocks - radius no pair is
    missed. Every key is worked whole: one with more than ``chunk`` members is split into
    chunks by hash and all pairs of chunks are compared, each in its own group.
    """
    bounded_batches(prints.sparkSession)
    members = prints.select("bits", F.explode(_block_keys(blocks, share)).alias("key"))
    # Written, since a grouping beside the join it feeds is not split when a key is hot.
    shared = cut(members.groupBy("key").count().filter("count > 1"), "shared")
    members = members.join(shared, "key")
    chunks = F.ceil(F.col("count") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("bits"), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    spread = members.select("bits", "key", own.alias("own"), other.alias("other")).select(
        "bits", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("chunk")
    )
    sorted_ = spread.repartition("chunk").sortWithinPartitions("chunk", "bits")
    return sorted_.mapInArrow(lambda batches: _linked(batches, radius), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 4,
    radius: int = 4,
    blocks: int = 6,
    share: int = 2,
    key: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash`` (xxhash64 of the text), ``bits`` (its fingerprint) and ``component_id``.

    Texts are linked if their fingerprints differ in ``radius`` bits at most; the component is
    the smallest doc_id reachable by links. Texts without words have fingerprint zero and
    are linked like others. Rows that repeat come out repeated. A null key is never a
    component's name unless all its members are null. Other columns are ignored, an empty
    table gives an empty result.

    What is shuffled are fingerprints, once per choice of blocks, never texts. Copies are
    reduced to one fingerprint by partial aggregation first. Both sides of a join on a group
    are tables, so that adaptive execution splits a hot one.
    """
    prints = cut(fingerprints(docs, shingle=shingle, key=key, text=text), "prints")
    distinct = cut(prints.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(near_links(distinct.select("bits"), blocks=blocks, share=share, radius=radius, chunk=chunk))
    grouped = distinct.join(roots.withColumnRenamed("vertex", "bits"), "bits", "left")
    grouped = cut(grouped.withColumn("root", F.coalesce("root", "bits")), "grouped")
    names = cut(grouped.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    named = cut(grouped.join(names, "root").select("bits", "component_id"), "named")
    return prints.join(named, "bits").select("doc_id", "text_hash", "bits", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
