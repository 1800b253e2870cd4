"""Language of texts by character models with interpolated Kneser-Ney smoothing.

Each language has a model of letters in runs, a mark standing between runs. Counts of four
characters come from every row that may be learned from, added up by Spark; those of shorter
runs are Kneser-Ney's numbers of different left neighbours. Probabilities of all languages are
worked out by Spark, once per run of characters, and are a table of which no run is left out. The
most frequent go to the tasks as arrays sorted by hash; what a text has of the others is looked up
by a join. A text gets the language of the lowest cross-entropy per character, and is rejected if
that is high for the language.
"""

from __future__ import annotations

import functools
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import SIEVE_BITS, _sieve, bounded_batches, cut, learns_from, read_table, text_of

ORDER = 4
CHARACTER_BITS = 16
#: Most logarithms that go to every task, one per language and run or context: those of the most
#: frequent. The rest is met in a join, so results do not depend on the bound.
MODEL_RUNS = 4_000_000
#: Share of a language's own texts that its cross-entropy limit accepts.
ACCEPTED = 0.999
#: Characters at which a difference in cross-entropy counts fully for the score.
SURE_AT = 20
UNKNOWN = "und"
#: Keys a task gathers before it adds them up.
GATHERED = 1 << 22


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(code).isalpha() for code in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def characters(text: str) -> np.ndarray:
    """Letters in lower case as numbers, one zero for whatever stands between them.

    Three zeros lead and one ends; a text without letters gives an empty array.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    folded = np.where(letter, (codes ^ (codes >> CHARACTER_BITS) * 31) & 0xFFFF, 0).astype(np.int64)
    after_letter = np.r_[False, letter[:-1]]
    kept = folded[letter | after_letter]
    return np.concatenate([np.zeros(ORDER - 1, np.int64), kept, np.zeros(int(letter[-1]), np.int64)])


def runs(sequence: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` characters that end at each place after the lead, packed into one number."""
    packed = np.zeros(max(0, len(sequence) - ORDER + 1), dtype=np.int64)
    for back in range(order):
        packed |= sequence[ORDER - 1 - back : len(sequence) - back] << (CHARACTER_BITS * back)
    return packed


def run_counts(texts: DataFrame) -> DataFrame:
    """(lang, run, n): occurrences of every run of four over all ``texts`` (text, lang)."""
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def added() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                run, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(run), pa.string()), pa.array(run), pa.array(n.astype(np.int64))],
                    ["lang", "run", "n"],
                )
            held.clear()

        size = 0
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                found = runs(characters(text), ORDER)
                held.setdefault(lang, []).append(found)
                size += len(found)
                if size >= GATHERED:
                    yield from added()
                    size = 0
        yield from added()

    partial = texts.select("text", "lang").mapInArrow(count, "lang string, run long, n long")
    return partial.groupBy("lang", "run").agg(F.sum("n").alias("n"))


#: Occurrences from which on runs count as equally frequent for the bound.
_OFTEN = 10_000


def _least(counts: DataFrame, bound: int) -> int:
    """The least count, ``_OFTEN`` at most, such that at most ``bound`` rows reach it; one more if there is none."""
    spread = counts.groupBy(F.least("n", F.lit(_OFTEN)).alias("n")).count().orderBy(F.desc("n")).collect()
    held, least = 0, _OFTEN + 1
    for row in spread:
        held += row["count"]
        if held > bound:
            break
        least = row["n"]
    return least


def _bounded(counts: DataFrame, bound: int) -> DataFrame:
    """Runs that occur often enough for tasks to hold at most ``bound`` of them."""
    return counts.filter(F.least("n", F.lit(_OFTEN)) >= _least(counts, bound))


def _hashed(packed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> np.uint64(32))


def _off(once: int, twice: int) -> float:
    return float(once / (once + 2 * twice)) if once and twice else 0.5


def _discount(counts: np.ndarray) -> float:
    return _off((counts == 1).sum(), (counts == 2).sum())


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _mask(order: int) -> int:
    return (1 << (CHARACTER_BITS * order)) - 1 if order < ORDER else -1


def _context(run: Column) -> Column:
    return F.shiftrightunsigned(run, CHARACTER_BITS)


def _vectors(rows: DataFrame, key: str, absent: float, languages: int) -> DataFrame:
    """(key, vector, n) of rows (key, place, value, seen): a value per language, and occurrences in all."""
    held = F.map_from_entries(F.collect_list(F.struct("place", "value")))
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(languages - 1)), lambda place: F.coalesce(F.try_element_at("_held", place), F.lit(absent))
    )
    grouped = rows.groupBy(key).agg(held.alias("_held"), F.sum("seen").alias("n"))
    return grouped.select(key, vector.alias("vector"), "n")


def _logs(vector: str) -> Column:
    return F.transform(vector, lambda value: F.log(value).cast("float"))


def entries(counts: DataFrame) -> tuple[DataFrame, list[str], int]:
    """(kind, key, logs, n), the languages in the order of ``logs``, and the number of characters.

    Kinds 1 to 4 are runs of so many characters that some language has, with the log-probabilities
    of the last one in all languages; 4 more is for the contexts of these runs, with the logs of
    what they leave to shorter runs. ``n`` counts occurrences. ``counts``: lang, run, n.
    """
    levels = {ORDER: counts.select("lang", "run", "n", F.col("n").alias("seen"))}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("run").bitwiseAND(F.lit(_mask(order)).cast("long")).alias("run")
        grouped = levels[order + 1].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("seen"))
        levels[order] = cut(grouped, f"runs{order}")
    rare = [F.sum((F.col("n") == times).cast("long")) for times in (1, 2)]
    off = {order: {lang: _off(*few) for lang, *few in levels[order].groupBy("lang").agg(*rare).collect()} for order in levels}
    names = sorted(off[1])
    if not names:
        return counts.limit(0), names, 1
    alphabet = levels[1].select("run").distinct().count()
    place = F.create_map(*(F.lit(x) for pair in zip(names, range(len(names))) for x in pair))[F.col("lang")]
    found, below = [], None
    for order in range(1, ORDER + 1):
        less = F.create_map(*(F.lit(x) for pair in off[order].items() for x in pair))[F.col("lang")]
        level = levels[order].withColumns({"context": _context(F.col("run")), "place": place, "less": less})
        sums = level.groupBy("lang", "place", "less", "context").agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("seen").alias("seen")
        )
        left = _vectors(sums.withColumn("value", F.col("less") * F.col("kinds") / F.col("total")), "context", 1.0, len(names))
        left = cut(left, f"left{order}")
        own = level.join(sums.select("lang", "context", "total"), ["lang", "context"])
        own = own.withColumn("value", F.greatest(F.col("n") - F.col("less"), F.lit(0.0)) / F.col("total"))
        own = _vectors(own, "run", 0.0, len(names)).withColumn("context", _context(F.col("run")))
        met = own.join(left.select("context", F.col("vector").alias("left")), "context")
        if below is None:
            met = met.withColumn("rest", F.array_repeat(F.lit(1 / alphabet), len(names)))
        else:
            shorter = F.col("run").bitwiseAND(F.lit(_mask(order - 1)).cast("long"))
            rest = below.select(F.col("run").alias("shorter"), F.col("chance").alias("rest"))
            met = met.join(rest, shorter == F.col("shorter"))
        passed = F.zip_with("left", "rest", lambda one, other: one * other)
        chance = F.zip_with("vector", passed, lambda one, other: one + other)
        below = cut(met.select("run", chance.alias("chance"), "n"), f"chance{order}")
        found.append(below.select(F.lit(order).alias("kind"), F.col("run").alias("key"), _logs("chance").alias("logs"), "n"))
        found.append(left.select(F.lit(ORDER + order).alias("kind"), F.col("context").alias("key"), _logs("vector").alias("logs"), "n"))
    return cut(functools.reduce(DataFrame.unionByName, found), "entries"), names, alphabet


def _unseen(alphabet: int) -> float:
    return float(-np.log(alphabet + 1))


def _tables(rows: pa.Table, languages: int, alphabet: int) -> list[dict]:
    """By order, from one character up, the entries given as arrays sorted by hash."""
    kind = rows.column("kind").to_numpy()
    key = _hashed(rows.column("key").to_numpy())
    logs = rows.column("logs").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(-1, languages)
    tables = []
    for order in range(1, ORDER + 1):
        table = {"unseen": _unseen(alphabet)}
        for one, keys, values in ((order, "runs", "logs"), (ORDER + order, "contexts", "left")):
            chosen = np.flatnonzero(kind == one)
            chosen = chosen[np.argsort(key[chosen])]
            table |= {keys: key[chosen], values: logs[chosen]}
        tables.append(table)
    return tables


def _slots(kind, key: np.ndarray) -> np.ndarray:
    """Bits of the sieve for runs or contexts of a kind."""
    with np.errstate(over="ignore"):
        spread = _hashed(key) + np.asarray(kind).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (_hashed(spread) & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)


def _sieve_of(rest: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for every entry (kind, key) of ``rest``."""

    @F.arrow_udf("long")
    def slot(kind: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array(_slots(kind.to_numpy(zero_copy_only=False), key.to_numpy(zero_copy_only=False)))

    sieve = np.zeros(1 << (SIEVE_BITS - 3), dtype=np.uint8)
    for row in _sieve(rest.select(slot("kind", "key").alias("value"))).toLocalIterator():
        bits = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        begin = (row["bucket"] - 1) * len(bits)
        sieve[begin : begin + len(bits)] = bits
    return sieve


def _maybe(sieve: np.ndarray, kind: int, key: np.ndarray) -> np.ndarray:
    slots = _slots(kind, key)
    return (sieve[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def log_sums(tables: list[dict], sequence: np.ndarray, languages: int, sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per language the sum of log-probabilities, without those of the runs of four returned beside it.

    These are the runs for which the ``sieve`` says that the tables may lack something of them.
    """
    total = np.zeros(languages)
    places = np.arange(len(sequence) - ORDER + 1)
    owed = np.zeros((len(places), languages), dtype=np.float32)
    doubtful = []
    for order in range(ORDER, 0, -1):
        table = tables[order - 1]
        wanted = runs(sequence, order)[places]
        at, there = _found(table["runs"], _hashed(wanted))
        total += (table["logs"][at[there]] + owed[there]).sum(axis=0, dtype=np.float64)
        places, owed, wanted = places[~there], owed[~there], wanted[~there]
        if not len(places):
            break
        context = (wanted.view(np.uint64) >> np.uint64(CHARACTER_BITS)).astype(np.int64)
        at, there = _found(table["contexts"], _hashed(context))
        owed[there] += table["left"][at[there]]
        if sieve is not None:
            doubt = _maybe(sieve, order, wanted) | (~there & _maybe(sieve, ORDER + order, context))
            doubtful.append(places[doubt])
            places, owed = places[~doubt], owed[~doubt]
    total += (owed + tables[0]["unseen"]).sum(axis=0, dtype=np.float64) if len(places) else 0
    return total, runs(sequence, ORDER)[np.concatenate(doubtful)] if doubtful else np.empty(0, np.int64)


def cross_entropy(tables: list[dict], sequence: np.ndarray, languages: int) -> np.ndarray:
    """Per language, minus the mean log-probability of the characters of a sequence."""
    return -log_sums(tables, sequence, languages)[0] / (len(sequence) - ORDER + 1)


def train(docs: DataFrame, *, bound: int = MODEL_RUNS) -> dict:
    """The model of every language in ``docs`` (doc_id, text, lang), of all rows to learn from.

    ``tables`` holds at most ``bound`` logarithms, ``entries`` all of them as a table; ``sieve``
    tells what of it may be missing in ``tables``, and is None if nothing is.
    """
    texts = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learns_from())
    found, names, alphabet = entries(cut(run_counts(texts), "runs"))
    if not names:
        return {"names": [], "tables": [], "sieve": None}
    frequent = F.least("n", F.lit(_OFTEN)) >= _least(found, bound // len(names))
    tables = _tables(found.filter(frequent).select("kind", "key", "logs").toArrow(), len(names), alphabet)
    rest = found.filter(~frequent)
    sieve = None if rest.isEmpty() else _sieve_of(rest)
    return {"names": names, "tables": tables, "sieve": sieve, "entries": found, "alphabet": alphabet}


@functools.lru_cache(maxsize=2)
def _loaded(model: bytes) -> dict:
    return pickle.loads(model)


RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64())])


SUMS = pa.struct([("sums", pa.list_(pa.float64())), ("count", pa.int64()), ("doubtful", pa.list_(pa.int64()))])


def _verdict(names: list[str], sums: np.ndarray, count: int) -> dict:
    """Language, its share among all by likelihood, and its cross-entropy."""
    if not count or not names:
        return {"lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": None}
    found = -np.asarray(sums) / count
    best = int(found.argmin())
    score = 1 / np.exp(-min(count, SURE_AT) * (found - found[best])).sum()
    return {"lang_pred": names[best], "score": float(score), "cross_entropy": float(found[best])}


def _summed(model: dict, text: str) -> dict:
    sequence = characters(text)
    names = model["names"]
    if not len(sequence) or not names:
        return {"sums": [0.0] * len(names), "count": 0, "doubtful": []}
    sums, doubtful = log_sums(model["tables"], sequence, len(names), model["sieve"])
    return {"sums": sums, "count": len(sequence) - ORDER + 1, "doubtful": doubtful}


def _looked_up(wanted: DataFrame, model: dict) -> DataFrame:
    """(run, logs) for runs of four (run), each once, from all entries of the model."""
    keys = []
    for order in range(1, ORDER + 1):
        run = F.col("run").bitwiseAND(F.lit(_mask(order)).cast("long"))
        keys += [F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in ((order, run), (ORDER + order, _context(run)))]
    asked = wanted.select("run", F.explode(F.array(*keys)).alias("_asked")).select("run", "_asked.*")
    met = asked.join(model["entries"].select("kind", "key", "logs"), ["kind", "key"])
    held = met.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("kind", "logs"))).alias("_held"))
    logs = F.array_repeat(F.lit(_unseen(model["alphabet"])), len(model["names"]))
    for order in range(1, ORDER + 1):
        known, left = (F.try_element_at("_held", F.lit(kind)).cast("array<double>") for kind in (order, ORDER + order))
        passed = F.when(left.isNull(), logs).otherwise(F.zip_with(left, logs, lambda one, other: one + other))
        logs = F.coalesce(known, passed)
    # The context of a single character is there for any run.
    return held.select("run", logs.alias("logs"))


def identify(docs: DataFrame, model: dict, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy) per row, from the text alone.

    A null text and one without letters are ``und`` with score 0 and no cross-entropy; of
    equal cross-entropies the first language by name counts. Rows are independent, repeated
    rows come out repeated, and texts are not shuffled. The part of the model bounded by
    ``MODEL_RUNS`` is broadcast. Runs of a text that it may lack are joined with all entries, and
    what they add is summed per row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = model["names"]
    shared = spark.sparkContext.broadcast(pickle.dumps({part: model[part] for part in ("names", "tables", "sieve")}))

    if model["sieve"] is None:

        @F.arrow_udf("lang_pred string, score double, cross_entropy double")
        def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = _loaded(shared.value)
            for batch in batches:
                found = [_summed(known, value) for value in batch.to_pylist()]
                yield pa.array([_verdict(names, one["sums"], one["count"]) for one in found], RESULT)

        found = docs.select(F.col(key).alias("doc_id"), judged(text_of(text)).alias("_judged"))
        return found.select("doc_id", "_judged.*")

    @F.arrow_udf("sums array<double>, count long, doubtful array<long>")
    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _loaded(shared.value)
        for batch in batches:
            yield pa.array([_summed(known, value) for value in batch.to_pylist()], SUMS)

    @F.arrow_udf("lang_pred string, score double, cross_entropy double")
    def decided(sums: pa.Array, count: pa.Array) -> pa.Array:
        return pa.array([_verdict(names, *one) for one in zip(sums.to_pylist(), count.to_pylist())], RESULT)

    found = docs.select(F.col(key).alias("doc_id"), summed(text_of(text)).alias("_summed"))
    known = cut(found.select("doc_id", "_summed.*").withColumn("_row", F.monotonically_increasing_id()), "sums")
    opened = known.select("_row", F.explode("doubtful").alias("run")).groupBy("_row", "run").agg(F.count(F.lit(1)).alias("n"))
    met = opened.join(_looked_up(opened.select("run").distinct(), model), "run")
    more = met.groupBy("_row").agg(F.array(*(F.sum(F.col("n") * F.col("logs")[at]) for at in range(len(names)))).alias("more"))
    sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda one, other: one + other))
    whole = known.join(more, "_row", "left").select("doc_id", decided(sums, F.col("count")).alias("_judged"))
    return whole.select("doc_id", "_judged.*")


def limits(judged: DataFrame, docs: DataFrame, *, accepted: float = ACCEPTED) -> DataFrame:
    """(lang_pred, limit): the cross-entropy that this share of a language's own texts stays under."""
    known = docs.filter(F.col("lang").isNotNull() & learns_from()).select("doc_id", "lang")
    own = judged.join(known, "doc_id").filter("lang = lang_pred")
    return own.groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", accepted, 1000).alias("limit"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = cut(identify(docs, train(docs)), "judged")
    # A row per language of the model, which the driver holds already.
    calibrated = judged.join(F.broadcast(limits(judged, docs)), "lang_pred", "left")
    return calibrated.select(
        "doc_id",
        (~learns_from()).alias("held_out"),
        "lang_pred",
        "score",
        "cross_entropy",
        F.coalesce(F.col("cross_entropy") <= F.col("limit"), F.lit(False)).alias("accepted"),
    )
