"""Repeated passages by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.llm.common import cut, fresh, read_table, text_of

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _full_lines(text: Column) -> Column:
    """Lines that are not blank, trimmed, each with its place."""
    placed = F.transform(_lines(text), lambda line, at: F.struct(at.alias("at"), F.trim(line).alias("line")))
    return F.filter(placed, lambda entry: entry["line"] != "")


def _windows(lines: Column) -> Column:
    """Hash of each run of three lines and the places of its lines."""

    def window(at: Column) -> Column:
        run = [F.get(lines, at + step) for step in range(WINDOW)]
        return F.struct(
            F.unhex(F.md5(F.concat_ws("\n", *(entry["line"] for entry in run)))).alias("hash"),
            F.array(*(entry["at"] for entry in run)).alias("covered"),
        )

    last = F.size(lines) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window))


def repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with repeats: ``doc_id`` and ``removed``, the sorted places of its lines to go.

    A window is three lines running that are not blank, compared without blanks at their
    ends. Of windows that occur more than once in the table the first, by key and place,
    stays, and every line that a later one covers goes, also where it lies in the first of
    another window. Blank lines stay. Documents of fewer than three such lines have no
    window. Keys are taken as unique whole numbers: rows that share one are one document, and
    rows without a key are left out of the comparison.

    A window travels as hash and place. Occurrences are counted by partial sums; the join
    that finds later ones has one row per repeated window on its short side, so a passage
    that a third of all documents share is split as a skewed join.
    """
    found = (
        docs.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("doc_id"), _full_lines(text_of(text)).alias("_lines"))
        .select("doc_id", F.explode(_windows(F.col("_lines"))).alias("_window"))
        .select("doc_id", "_window.hash", "_window.covered")
        .withColumn("place", F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 31) + F.get("covered", F.lit(0)))
        .withColumn("place", F.col("place").cast("decimal(38,0)"))
    )
    found = cut(found, "windows")
    repeated = found.groupBy("hash").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1").drop("n")
    later = found.join(repeated, "hash").filter("place > first")
    return (
        later.select("doc_id", F.explode("covered").alias("at"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("at")).alias("removed"))
    )


def without_repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with lines removed from its texts, and ``n_lines`` and ``n_removed`` per row.

    A null text stays null and has no lines; an empty text has one. Columns of those two
    names are replaced.
    """
    found = cut(repeated_lines(docs, key=key, text=text), "removed")
    left_key, gone = fresh(docs, "_key"), fresh(docs, "_gone")
    found = found.select(F.col("doc_id").alias(left_key), F.col("removed").alias(gone))
    # One plan at every size: what was found grows with the documents and is never broadcast.
    rows = docs.drop("n_lines", "n_removed").join(found.hint("merge"), F.col(key) == F.col(left_key), "left")
    lines, untouched = _lines(F.col(text)), F.col(gone).isNull()
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda at: F.get(lines, at))
    return (
        rows.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.when(untouched, 0).otherwise(F.size(gone)).cast("long"))
        .withColumn(text, F.when(untouched, F.col(text)).otherwise(F.array_join(left, "\n")))
        .drop(left_key, gone)
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), windows AS (
    SELECT doc_id, place, lead(place) OVER run AS place2, lead(place, 2) OVER run AS place3,
           trim(line) || chr(10) || lead(trim(line)) OVER run || chr(10) || lead(trim(line), 2) OVER run AS passage
    FROM lines WHERE trim(line) <> ''
    WINDOW run AS (PARTITION BY doc_id ORDER BY place)
), later AS (
    SELECT doc_id, place, place2, place3 FROM windows WHERE passage IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, place) > 1
), covered AS (
    SELECT doc_id, place FROM later
    UNION SELECT doc_id, place2 FROM later
    UNION SELECT doc_id, place3 FROM later
), cleaned AS (
    SELECT lines.doc_id, count(*) AS n_lines, count(covered.place) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY lines.place) FILTER (covered.place IS NULL), '') AS text
    FROM lines LEFT JOIN covered ON lines.doc_id = covered.doc_id AND lines.place = covered.place
    GROUP BY lines.doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, cleaned.text AS text
FROM documents LEFT JOIN cleaned USING (doc_id)
"""
