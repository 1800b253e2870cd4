"""Reading tables, cutting lineage, and words for the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import slipway
from slipway.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

#: Rows and bytes of a batch sent to Python; whole texts are long, so a batch is kept small.
BATCH_ROWS = "1000"
BATCH_BYTES = "16m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Remembered:
    """A bounded memory of what was worked out for words, in two generations.

    ``get`` reads the young one. What it lacks comes from ``other``: from the old one, else
    from ``find``. A full young generation becomes the old one, so what is used often stays.
    """

    def __init__(self, find: Callable, entries: int):
        self.find, self.entries = find, entries
        self.clear()

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def other(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.find(word)
        if len(self.young) >= self.entries:
            self.old = dict(self.young)
            self.young.clear()
        self.young[word] = found
        return found


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let the driver serve this package to Python workers, once per application.

    Workers import the operators' helpers by name, wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(slipway.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="slipway-code-")) / "slipway-package.zip"
    with zipfile.ZipFile(archive, "w") as into:
        for file in sorted(package.rglob("*.py")):
            into.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def bounded_batches(spark: SparkSession) -> None:
    """What every operator with Python asks for: its code there, and batches of bounded size."""
    send_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there.

    Lineage ends at the table, its size is known to the planner, and a lost executor takes
    nothing with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a sieve: at most 16 MB, whatever the number of values it holds.
SIEVE_BITS = 27


def _sieve(values: DataFrame) -> DataFrame:
    """(bucket, bits): a bit set for every value of ``values`` (value long), in pieces of 4 KB."""
    place = F.pmod(F.col("value"), F.lit(1 << SIEVE_BITS)) + 1
    placed = values.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return placed.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def sifted(rows: DataFrame, value: Column, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``value`` may be among ``values`` (value long), and the rest.

    The test is a bitmap of fixed size that goes to all tasks, so the rest, whole texts for the
    most part, stays where it is. The first part holds every row whose value is there, and
    others by chance: the more, the more values there are. A null value is never among them.
    """
    bucket, bits = fresh(rows, "_bucket"), fresh(rows, "_bits")
    place = F.pmod(value, F.lit(1 << SIEVE_BITS)) + 1
    pieces = _sieve(values).withColumnsRenamed({"bucket": bucket, "bits": bits})
    met = rows.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(pieces), bucket, "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return met.filter(may).select(*rows.columns), met.filter(~may).select(*rows.columns)


def without_rows(docs: DataFrame, dropped: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``dropped`` (doc_id, text_hash) names by key and xxhash64 of the text.

    Rows without a key stay. Only rows that may be named are shuffled. ``docs`` is read twice,
    so it should be a table.
    """
    left_key, left_hash, text_hash = (fresh(docs, name) for name in ("_key", "_hash", "_text_hash"))
    kind = docs.schema[key].dataType
    named = cut(dropped.select(F.col("doc_id").cast(kind).alias(left_key), F.col("text_hash").alias(left_hash)).distinct(), "dropped")
    hashed = docs.withColumn(text_hash, F.xxhash64(text_of(text)))
    may, rest = sifted(
        hashed, F.xxhash64(F.col(key), F.col(text_hash)), named.select(F.xxhash64(left_key, left_hash).alias("value"))
    )
    same = (F.col(key) == F.col(left_key)) & (F.col(text_hash) == F.col(left_hash))
    left = may.join(named.hint("merge"), same, "left_anti")
    return left.unionByName(rest).select(*docs.columns)


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def learns_from(doc_id: str = "doc_id") -> Column:
    """Rows a model may learn from: crc32 of the id as text is no multiple of five."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0
