"""Secrets in texts, found through a ledger of contents.

A text is addressed by its hash, whatever documents or versions hold it. The ledger says which
contents have been scanned under which rules; a run scans only pairs it has not seen, appends
them, and joins what is known of a content back to every document that holds it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import bounded_batches, cut, read_table, text_of
from slipway.session import shared_dir

#: Fixed values. Patterns of the kinds, the group that is measured and its least length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RULES = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Order of kinds that start at the same place; the base ones come first.
KINDS = ("assign", "access", "hex", "github", "pem", "jwt")

#: Names the rules a content was scanned with; a change of any rule needs a new name.
RULE_VERSION = "2"

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"

# The measured runs are maximal, so asking for their length at once finds the same ones. Not
# so for assignments: one that is too short still takes its place in the text.
_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ASSIGN_HINT = re.compile("password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.DOTALL)
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of a text in code points, by start and then kind."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [("assign", *match.span()) for match in _ASSIGN.finditer(text) if len(match[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *match.span()) for match in _ACCESS.finditer(text)]
    found += [("hex", *match.span()) for match in _HEX.finditer(text)]
    if "gh" in text:
        found += [("github", *match.span()) for match in _GITHUB.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [("pem", *match.span()) for match in _PEM.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", *match.span()) for match in _JWT.finditer(text)]
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        spans = [
            [{"kind": name, "start": start, "end": end} for name, start, end in find_spans(text)]
            for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, pa.list_(kind))], ["blob", "spans"])


class BlobLedger:
    """Scans by content and rule version, as a Parquet table that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All entries; an interrupted scan may have left a pair twice, with the same spans."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER)

    def scan(self, texts: DataFrame, version: str = RULE_VERSION) -> None:
        """Scan contents of ``texts`` (blob, text) that the ledger lacks under ``version``.

        Copies of a content are reduced to one in each task before anything is moved.
        """
        bounded_batches(self.spark)
        seen = self.read().filter(F.col("rule_version") == version).select("blob")
        unseen = texts.dropDuplicates(["blob"]).join(seen, "blob", "left_anti")
        spans = unseen.select("blob", "text").mapInArrow(_scanned, f"blob binary, spans {SPANS}")
        spans.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(self.path)

    def findings(self, version: str = RULE_VERSION) -> DataFrame:
        """Contents with secrets, one row each."""
        known = self.read().filter((F.col("rule_version") == version) & (F.size("spans") > 0))
        return known.select("blob", "spans").dropDuplicates(["blob"])


def secret_spans(docs: DataFrame, ledger: BlobLedger, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its key as ``doc_id`` and ``spans``, all secrets of its whole text.

    A null text counts as empty; texts without secrets have an empty list. Rows with equal
    texts, repeated rows too, share one scan and each get its findings, null keys as well.
    Other columns of ``docs`` are ignored.
    """
    versions = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    versions = versions.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    ledger.scan(versions.select("blob", "text"))
    found = versions.select("doc_id", "blob").join(ledger.findings(), "blob", "left")
    return found.select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = BlobLedger(spark, f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}")
    found = cut(secret_spans(read_table(spark, sf_dir, "documents"), ledger), "spans")
    base = F.filter("spans", lambda span: span["kind"].isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
