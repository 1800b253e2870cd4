"""Log texts and log lines of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.functions import text as X
from slipway.functions.joins import lookup_join, top_k

# Fixed value: the prefix of a line that starts a log entry.
STAMP = r"\[([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z)\] "
ENTRY = rf"\A{STAMP}"

# Above every time of an entry written as one number.
STAMP_STEP = 10**14

LABEL = "Remote Standard Output"


def split_lines(logs: DataFrame) -> DataFrame:
    """Rows (run_id, stream, line_no, line) from whole log texts, numbered from 1."""
    return logs.select(
        "run_id", "stream", F.posexplode(F.split("text", C.LINE_BREAK, -1)).alias("_pos", "line")
    ).select("run_id", "stream", (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def log_tail(logs: DataFrame, n: int = C.TAIL_LINES) -> DataFrame:
    """What to show of each log text: the end of stdout, all of stderr, nothing if blank.

    ``logs`` has one row per run and stream, so every step is local to its row.
    """
    content = X.strip(F.col("text"))
    lines = logs.withColumn("_text", content).filter(F.col("_text") != "").withColumn(
        "_lines", F.split("_text", C.LINE_BREAK, -1)
    )
    cut = (F.col("stream") == "stdout") & (F.size("_lines") > n)
    # "Last n" from the end; the guard keeps the index in range for short texts.
    last = F.slice(F.col("_lines"), F.greatest(F.size("_lines") - n + 1, F.lit(1)), F.lit(n))
    return lines.select(
        "run_id",
        "stream",
        F.when(F.col("stream") == "stdout", F.lit("output")).otherwise(F.lit("error")).alias("kind"),
        F.size("_lines").alias("total_lines"),
        cut.alias("truncated"),
        F.when(cut, F.lit(f"{LABEL} (last {n} lines)"))
        .when(F.col("stream") == "stdout", F.lit(LABEL))
        .otherwise(F.lit("Remote Standard Error"))
        .alias("label"),
        F.when(cut, F.concat(F.lit(C.TRUNCATED_MARKER + "\n"), F.array_join(last, "\n")))
        .otherwise(F.col("_text"))
        .alias("message"),
    )


def failure_events(logs: DataFrame, outcomes: DataFrame, n: int = C.TAIL_LINES) -> DataFrame:
    """The output and error events of runs that ended with a bad exit code.

    ``outcomes`` has one row per run, as ``run_outcome`` gives it. The texts are cut before
    they meet it, and by an inner join: a semi join would be moved ahead of the cut and
    could shuffle whole logs.
    """
    failed = outcomes.filter(F.col("outcome") == "failed").select("run_id")
    return log_tail(logs, n).join(failed, "run_id").select("run_id", "kind", "message")


def stdout_tail(lines: DataFrame, n: int = C.TAIL_LINES) -> DataFrame:
    """The last ``n`` stdout lines of every run, from a table of numbered lines.

    For logs too long to hold as one text. White space around the whole log does not
    count, so the tail ends at the last line with content. The last ``n`` lines with
    content are cut per task before they shuffle; of the lines between them, only those
    holding white space are looked up, and empty ones follow from the numbering.
    """
    stdout = lines.filter(F.col("stream") == "stdout").select("run_id", "line_no", "line")
    has_text = X.strip(F.col("line")) != ""
    full = stdout.filter(has_text)
    bounds = full.groupBy("run_id").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last")
    )
    bounds = bounds.select(
        "run_id", "first", "last", F.greatest(F.col("first"), F.col("last") - (n - 1)).alias("start")
    )
    recent = top_k(full, ["run_id"], [F.col("line_no").desc()], n)
    spaces = lookup_join(
        stdout.filter(~has_text & (F.col("line") != "")), bounds, ["run_id"], ["line_no"], how="inner"
    ).filter(F.col("line_no").between(F.col("start"), F.col("last")))
    kept = recent.select("run_id", "line_no", "line").unionByName(
        spaces.select("run_id", "line_no", "line")
    )
    # At most 2 n - 1 short rows per run meet here.
    found = kept.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("line_no", "line"))).alias("_found")
    )
    at = F.transform(
        F.sequence("start", "last"),
        lambda number: F.coalesce(F.try_element_at(F.col("_found"), number), F.lit("")),
    )
    text = F.array_join(at, "\n")
    whole = F.col("start") == F.col("first")
    total = F.col("last") - F.col("first") + 1
    return (
        bounds.join(found, "run_id")
        .select(
            "run_id",
            total.alias("total_lines"),
            (total > n).alias("truncated"),
            X.strip_right(F.when(whole, X.strip_left(text)).otherwise(text)).alias("_tail"),
        )
        .select(
            "run_id",
            "total_lines",
            "truncated",
            F.when(F.col("truncated"), F.concat(F.lit(C.TRUNCATED_MARKER + "\n"), F.col("_tail")))
            .otherwise(F.col("_tail"))
            .alias("message"),
        )
    )


def log_entries(logs: DataFrame) -> DataFrame:
    """The entries of whole log texts: number, time and message with its further lines.

    What stands ahead of the first time prefix is an entry without a time. Every step is
    local to its row; for logs too long for one row see ``parse_run_log``.
    """
    pieces = logs.select(
        "run_id", "stream", F.posexplode(F.split("text", rf"\n(?={STAMP})", -1)).alias("_pos", "_piece")
    )
    stamp = F.regexp_extract("_piece", ENTRY, 1)
    return pieces.select(
        "run_id",
        "stream",
        (F.col("_pos") + 1).alias("entry"),
        F.nullif(stamp, F.lit("")).alias("logged_at"),
        X.strip_right(F.regexp_replace("_piece", ENTRY, "")).alias("message"),
    )


def parse_run_log(lines: DataFrame, block_lines: int = 100_000) -> DataFrame:
    """Every log line with the entry of its stream it belongs to and that entry's time.

    A line with a time prefix starts an entry; other lines continue the one before, and
    lines ahead of the first entry belong to none. The search back for the entry runs
    within blocks of ``block_lines`` lines; the last entry of earlier blocks is carried
    over in a second, small pass, so a very long log is many tasks and not one. Number and
    time of an entry travel as one number, of which the largest is the last.
    """
    stamp = F.regexp_extract("line", ENTRY, 1)
    digits = F.regexp_replace(stamp, "[^0-9]", "").cast("decimal(14,0)")
    place = F.col("line_no").cast("decimal(20,0)") * F.lit(STAMP_STEP).cast("decimal(15,0)")
    marked = lines.select(
        "run_id",
        "stream",
        "line_no",
        F.floor(F.col("line_no") / block_lines).alias("_block"),
        "line",
        F.when(stamp != "", (place + digits).cast("decimal(38,0)")).alias("_start"),
    )
    log = ["run_id", "stream"]
    blocks = marked.groupBy(*log, "_block").agg(F.max("_start").alias("_last"))
    earlier = W.partitionBy(*log).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*log, "_block", F.max("_last").over(earlier).alias("_carried"))
    so_far = W.partitionBy(*log, "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = marked.withColumn("_own", F.max("_start").over(so_far))
    rows = placed.join(carried, [*log, "_block"], "left").withColumn("_entry", F.coalesce("_own", "_carried"))
    entry_line = F.expr(f"_entry div {STAMP_STEP}")
    time = F.lpad(F.expr(f"cast(_entry % {STAMP_STEP} as string)"), 14, "0")
    is_start = F.col("_start").isNotNull()
    return rows.select(
        *log,
        "line_no",
        entry_line.alias("entry_line"),
        F.regexp_replace(time, "(....)(..)(..)(..)(..)(..)", "$1-$2-$3T$4:$5:$6Z").alias("logged_at"),
        (F.col("line_no") - entry_line).alias("part"),
        F.when(is_start, X.strip_right(F.regexp_replace("line", ENTRY, ""))).otherwise(F.col("line")).alias("message"),
    )
