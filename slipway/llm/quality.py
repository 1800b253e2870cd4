"""Quality of documents by a byte-level convolutional network.

Bytes are embedded, learned filters run over every window of a document, and each filter's
greatest response is taken over overlapping chunks. A small layer turns a chunk's responses into
a judgement, and the mean and the greatest judgement of all chunks give one probability.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import bounded_batches, cut, learns_from, read_table, text_of

#: The network is fitted on at most this many documents of each label, chosen by a hash of
#: their ids, and sees at most this many chunks of each while it is fitted.
SAMPLE_PER_LABEL = 900
SAMPLE_CHUNKS = 16
THRESHOLD = 0.3

EMBEDDED, WIDTH, FILTERS, HIDDEN = 6, 8, 24, 12
#: Responses are first reduced to strips of windows; chunks are CHUNK_STRIPS strips that overlap.
STRIP, CHUNK_STRIPS = 64, 3
CHUNK_STEP = 2
SPAN = STRIP * CHUNK_STRIPS
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.01, 1e-4


def padded(data: bytes) -> np.ndarray:
    """Bytes with zeros around; a text shorter than a chunk is filled up to one."""
    behind = max(WIDTH - 1, SPAN - len(data))
    return np.frombuffer(bytes(WIDTH - 1) + data + bytes(behind), dtype=np.uint8)


def _responses(weights: dict, data: np.ndarray) -> np.ndarray:
    """Greatest response of each filter in each strip of windows of the whole text."""
    windows = len(data) - WIDTH + 1
    strips = -(-windows // STRIP)
    out = np.empty((strips, FILTERS), dtype=np.float32)
    per_round = 32
    for first in range(0, strips, per_round):
        begin, end = first * STRIP, min(windows, (first + per_round) * STRIP)
        flat = weights["embed"][data[begin : end + WIDTH - 1]].ravel()
        view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBEDDED)[::EMBEDDED]
        reply = np.ascontiguousarray(view) @ weights["filters"]
        out[first : first + per_round] = np.maximum.reduceat(reply, range(0, end - begin, STRIP), axis=0)
    return np.maximum(out + weights["filter_bias"], 0)


def _chunk_responses(strips: np.ndarray) -> np.ndarray:
    """Overlapping chunks of CHUNK_STRIPS strips; the last ends with the text."""
    if len(strips) <= CHUNK_STRIPS:
        return strips.max(axis=0, keepdims=True)
    starts = list(range(0, len(strips) - CHUNK_STRIPS, CHUNK_STEP)) + [len(strips) - CHUNK_STRIPS]
    return np.stack([strips[start : start + CHUNK_STRIPS].max(axis=0) for start in starts])


def _judged(weights: dict, chunks: np.ndarray) -> np.ndarray:
    hidden = np.maximum(chunks @ weights["dense"] + weights["dense_bias"], 0)
    return hidden @ weights["judge"]


def _combined(weights: dict, judged: np.ndarray) -> float:
    return float(weights["mix"][0] * judged.mean() + weights["mix"][1] * judged.max() + weights["mix"][2])


def score_bytes(weights: dict, data: bytes) -> float:
    """Probability of label 1 for a whole text."""
    judged = _judged(weights, _chunk_responses(_responses(weights, padded(data))))
    logit = _combined(weights, judged) + weights["prior"]
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _initial(rng: np.random.Generator) -> dict:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "embed": normal(256, EMBEDDED, scale=0.5),
        "filters": normal(WIDTH * EMBEDDED, FILTERS, scale=(2 / (WIDTH * EMBEDDED)) ** 0.5),
        "filter_bias": np.zeros(FILTERS, dtype=np.float32),
        "dense": normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
        "dense_bias": np.zeros(HIDDEN, dtype=np.float32),
        "judge": normal(HIDDEN, scale=(1 / HIDDEN) ** 0.5),
        "mix": np.array([1.0, 0.0, 0.0], dtype=np.float32),
    }


def _forward(weights: dict, chunks: np.ndarray):
    """Greatest responses of whole chunks, and the window that gave each."""
    count, length = chunks.shape
    flat = weights["embed"][chunks].reshape(count, length * EMBEDDED)
    view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBEDDED, axis=1)[:, ::EMBEDDED]
    reply = np.ascontiguousarray(view).reshape(-1, WIDTH * EMBEDDED) @ weights["filters"]
    reply = reply.reshape(count, -1, FILTERS)
    at = reply.argmax(axis=1)
    best = np.take_along_axis(reply, at[:, None, :], axis=1)[:, 0] + weights["filter_bias"]
    return np.maximum(best, 0), at


def _gradients(weights: dict, chunks: np.ndarray, document: np.ndarray, labels: np.ndarray):
    """Of the mean loss; ``document`` has the place in ``labels`` of each chunk's document."""
    best, at = _forward(weights, chunks)
    before = best @ weights["dense"] + weights["dense_bias"]
    hidden = np.maximum(before, 0)
    judged = hidden @ weights["judge"]
    size = np.bincount(document, minlength=len(labels))
    mean = np.bincount(document, judged, len(labels)) / size
    order = np.lexsort((judged, document))
    top = order[np.cumsum(size) - 1]
    mix = weights["mix"]
    logit = mix[0] * mean + mix[1] * judged[top] + mix[2]
    d_logit = (1 / (1 + np.exp(-logit)) - labels) / len(labels)
    d_judged = (mix[0] * d_logit / size)[document]
    d_judged[top] += mix[1] * d_logit
    d_hidden = np.outer(d_judged, weights["judge"]) * (before > 0)
    d_best = (d_hidden @ weights["dense"].T) * (best > 0)
    span = np.arange(WIDTH)
    bytes_at = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + span]
    embedded = weights["embed"][bytes_at].reshape(len(chunks), FILTERS, -1)
    d_window = d_best[:, :, None] * weights["filters"].T[None]
    d_embed = np.zeros_like(weights["embed"])
    np.add.at(d_embed, bytes_at.ravel(), d_window.reshape(-1, EMBEDDED))
    return {
        "embed": d_embed,
        "filters": np.einsum("cfw,cf->wf", embedded, d_best),
        "filter_bias": d_best.sum(axis=0),
        "dense": best.T @ d_hidden,
        "dense_bias": d_hidden.sum(axis=0),
        "judge": hidden.T @ d_judged,
        "mix": np.array([mean @ d_logit, judged[top] @ d_logit, d_logit.sum()]),
    }


def fit(texts: list[list[bytes]], labels: list[int], share_of_ones: float, seed: int = 0) -> dict:
    """Weights of a network fitted to documents given as chunks of SPAN bytes or fewer.

    ``share_of_ones`` is that of the whole table; the sample's own share is taken out of
    the score. Without documents of both labels every text gets that share as its score.
    """
    rng = np.random.default_rng(seed)
    weights = _initial(rng)
    ones = sum(labels)
    share = min(max(share_of_ones, 1e-3), 1 - 1e-3)
    if ones in (0, len(labels)):
        weights["mix"][:] = 0
        return weights | {"prior": float(np.log(share / (1 - share)))}
    length = SPAN + WIDTH - 1
    blocks = []
    for chunks in texts:
        block = np.zeros((len(chunks), length), dtype=np.uint8)
        for row, chunk in zip(block, chunks):
            row[: len(chunk)] = np.frombuffer(chunk, dtype=np.uint8)
        blocks.append(block)
    target = np.array(labels, dtype=np.float64)
    moment = {name: np.zeros_like(value) for name, value in weights.items()}
    square = {name: np.zeros_like(value) for name, value in weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for chosen in np.array_split(rng.permutation(len(blocks)), -(-len(blocks) // BATCH)):
            document = np.repeat(np.arange(len(chosen)), [len(blocks[i]) for i in chosen])
            found = _gradients(weights, np.concatenate([blocks[i] for i in chosen]), document, target[chosen])
            step += 1
            for name, slope in found.items():
                slope = slope + DECAY * weights[name]
                moment[name] = 0.9 * moment[name] + 0.1 * slope
                square[name] = 0.99 * square[name] + 0.01 * slope**2
                change = moment[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
                weights[name] = (weights[name] - rate * change).astype(np.float32)
    prior = np.log(share / (1 - share)) - np.log(ones / (len(labels) - ones))
    return weights | {"prior": float(prior)}


def sample_chunks(data: bytes) -> list[bytes]:
    """At most SAMPLE_CHUNKS chunks, spread evenly over the text as the network sees it."""
    whole = padded(data).tobytes()
    length, step = SPAN + WIDTH - 1, STRIP * CHUNK_STEP
    starts = list(range(0, max(1, len(whole) - length), step))
    if len(whole) > length:
        starts.append(len(whole) - length)
    if len(starts) > SAMPLE_CHUNKS:
        starts = [starts[round(place * (len(starts) - 1) / (SAMPLE_CHUNKS - 1))] for place in range(SAMPLE_CHUNKS)]
    return [whole[start : start + length] for start in starts]


def labelled(docs: DataFrame, labels: DataFrame, *, label: str = "quality") -> DataFrame:
    """(doc_id, label) to learn from, each once; a document that has both labels counts for either."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    return known.filter(learns_from()).distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> dict:
    """Fit the network on a bounded sample; shares of labels are counted over all rows.

    What reaches the driver is at most 2 * per_label documents of SAMPLE_CHUNKS chunks each: of
    rows that share an id the one whose text has the least hash is taken.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = cut(labelled(docs, labels, label=label), "labelled")
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = [known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_label) for value in (0, 1)]
    ids = cut(chosen[0].union(chosen[1]), "sample")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [sample_chunks(text.encode("utf-8", "surrogatepass")) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(chunks, pa.list_(pa.binary()))],
                ["doc_id", "label", "chunks"],
            )

    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.mapInArrow(chunked, "doc_id long, label int, chunks array<binary>").collect()
    rows.sort(key=lambda row: (row["doc_id"], row["label"], row["chunks"]))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([row["chunks"] for row in rows], [row["label"] for row in rows], share)


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes) -> dict:
    return pickle.loads(model)


def score(docs: DataFrame, weights: dict, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text in the column ``out``.

    Null counts as empty, and empty texts are scored like others. Rows are independent and
    nothing is shuffled; a column that has the name ``out`` already is replaced. The weights
    are a few thousand numbers, whatever the corpus.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _loaded(shared.value)
        for batch in batches:
            texts = (value.encode("utf-8", "surrogatepass") for value in batch.to_pylist())
            yield pa.array([score_bytes(model, data) for data in texts], pa.float64())

    return docs.withColumn(out, scored(text_of(text)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, weights).select(
        "doc_id", (~learns_from()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
