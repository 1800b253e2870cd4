"""Provider and hub answers landed as JSON files, read into the operators' tables."""

from __future__ import annotations

import io
import re
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slipway.schemas import CODE_FILES

# One JSON document per line (or per file with multi_line=True).
_OFFER = (
    "struct<cloudId:string, gpuType:string, socket:string, provider:string, security:string, "
    "dataCenter:string, region:string, country:string, gpuMemory:double, gpuCount:int, "
    "stockStatus:string, isSpot:boolean, prices:struct<onDemand:double, communityPrice:double>, "
    "images:array<string>, disk:struct<min:double, max:double>>"
)
_SIBLING = "struct<rfilename:string, filename:string, path:string, size:bigint>"


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_offers(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Marketplace answers ``{"items": [offer, ...]}`` as one row per offer."""
    pages = _json(spark, path, f"items array<{_OFFER}>", multi_line)
    offer = pages.select(F.explode("items").alias("o")).filter(F.col("o").isNotNull())
    return offer.select(
        F.col("o.cloudId").alias("cloud_id"),
        F.col("o.gpuType").alias("gpu_type"),
        F.col("o.socket"),
        F.col("o.provider"),
        F.col("o.security"),
        F.col("o.dataCenter").alias("data_center"),
        F.col("o.region"),
        F.col("o.country"),
        F.col("o.gpuMemory").alias("gpu_memory"),
        F.col("o.gpuCount").alias("gpu_count"),
        F.col("o.stockStatus").alias("stock_status"),
        F.col("o.isSpot").alias("is_spot"),
        F.col("o.prices.onDemand").alias("price_on_demand"),
        F.col("o.prices.communityPrice").alias("price_community"),
        F.col("o.images"),
        F.col("o.disk.min").alias("disk_min_gb"),
        F.col("o.disk.max").alias("disk_max_gb"),
    )


def read_model_files(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Hub listings ``{"id": ..., "siblings": [file, ...]}`` as one row per file."""
    listing = _json(spark, path, f"id string, siblings array<{_SIBLING}>", multi_line)
    files = listing.select(F.col("id").alias("model_id"), F.explode_outer("siblings").alias("f"))
    name = F.coalesce(F.col("f.rfilename"), F.col("f.filename"), F.col("f.path"), F.lit(""))
    return files.select("model_id", name.alias("file_name"), F.col("f.size").alias("size_bytes"))


def read_tensor_counts(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Tensor metadata ``{"id": ..., "parameter_count": {dtype: n}}`` as one row per dtype."""
    meta = _json(spark, path, "id string, parameter_count map<string,bigint>", multi_line)
    return meta.select(
        F.col("id").alias("model_id"), F.explode("parameter_count").alias("dtype", "param_count")
    )


def read_volumes(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Volume listings ``{"volumes": [volume, ...]}``; ``seq`` keeps the listed order."""
    kind = "struct<id:string, name:string, dataCenterId:string, size:int>"
    listing = _json(spark, path, f"volumes array<{kind}>", multi_line)
    rows = listing.select(F.posexplode("volumes").alias("seq", "v")).filter(F.col("v").isNotNull())
    return rows.select(
        F.col("v.id").alias("volume_id"),
        F.col("v.name"),
        F.col("v.dataCenterId").alias("data_center_id"),
        F.col("v.size").alias("size_gb"),
        "seq",
    )


def _whole_files(spark: SparkSession, path: str, pattern: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return (
        reader.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file_path"))
    )


def _inside(path: str) -> str:
    """Pattern of a file's URI below ``path``; its first group is what follows."""
    root = re.sub(r"\A[A-Za-z0-9+.-]+:", "", path).strip("/")
    return rf"\A(?:[A-Za-z0-9+.-]+:)?/*\Q{root}\E/+(.*)\z"


def read_model_configs(spark: SparkSession, path: str) -> DataFrame:
    """``<path>/<org>/<model>/config.json`` trees as (model_id, config_json).

    The id is the folder below ``path``, also of models without an organisation.
    """
    below = F.regexp_extract("file_path", _inside(path), 1)
    model = F.regexp_replace(below, r"/?config\.json\z", "")
    return _whole_files(spark, path, "config.json").select(
        model.alias("model_id"), F.col("text").alias("config_json")
    )


def read_settings(spark: SparkSession, path: str, *, layer: int, run_id: Column | None = None) -> DataFrame:
    """Settings files (one JSON object each) as rows (run_id, layer, seq, key, value).

    ``run_id`` is an expression over ``file_path``; by default the name of the file's folder.
    Values keep their scalar text. A file that is no JSON object comes as one row with null
    key, which ``overlay_settings`` reports; an empty object as one row with an empty key,
    so that its run is known. An object has a key once, so ``seq`` only tells rows apart.
    """
    owner = run_id if run_id is not None else F.regexp_extract("file_path", r"([^/]+)/[^/]+\z", 1)
    files = _whole_files(spark, path, "*.json")
    parsed = files.select(
        owner.alias("run_id"),
        F.try_variant_get(F.try_parse_json("text"), "$", "map<string,string>").alias("entries"),
    )
    nothing = F.create_map(F.lit(""), F.lit(None).cast("string"))
    entries = F.when(F.size("entries") == 0, nothing).otherwise(F.col("entries"))
    rows = parsed.select("run_id", F.posexplode_outer(F.map_entries(entries)).alias("seq", "entry"))
    return rows.select(
        "run_id",
        F.lit(layer).alias("layer"),
        F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"),
        F.col("entry.key").alias("key"),
        F.col("entry.value").alias("value"),
    )


def read_run_logs(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """``<path>/<run_id>/logs/<stream>.log`` trees as (run_id, stream, text), one row per file.

    Logs outside such a folder are not taken; those a client keeps beside it are read with
    ``read_client_logs``. As a stream, every new file comes once; ``log_tail`` and
    ``split_lines`` work on it too.
    """
    place = F.col("file_path")
    inside = _whole_files(spark, path, "*.log", stream).filter(place.rlike(r"[^/]+/logs/[^/]+\.log\z"))
    return inside.select(
        F.regexp_extract(place, r"([^/]+)/logs/[^/]+\.log\z", 1).alias("run_id"),
        F.regexp_extract(place, r"([^/]+)\.log\z", 1).alias("stream"),
        "text",
    )


def read_client_logs(spark: SparkSession, path: str, name: str = "client.log") -> DataFrame:
    """``<path>/<run_id>/<name>`` as (run_id, stream, text): what the launching side wrote."""
    files = _whole_files(spark, path, name).filter(~F.col("file_path").rlike(r"/logs/[^/]+\z"))
    run_id = F.regexp_extract("file_path", r"([^/]+)/[^/]+\z", 1)
    return files.select(run_id.alias("run_id"), F.lit("client").alias("stream"), "text")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``<path>/<run_id>/logs/<stream>.log`` as numbered lines (run_id, stream, line_no, line).

    For logs too long for one row: a file is split into blocks like any text, lines are
    numbered within their block, and the lines of earlier blocks are added from a table
    of counts, one row per block. Lines end where Spark's text source ends them.
    """
    place = F.col("file_path")
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.log")
        .text(path)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("read"),
        )
        .filter(place.rlike(r"[^/]+/logs/[^/]+\.log\z"))
    )
    earlier = W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counts = lines.groupBy("file_path", "block").count()
    offsets = counts.select(
        "file_path", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")
    )
    in_block = F.row_number().over(W.partitionBy("file_path", "block").orderBy("read"))
    numbered = lines.withColumn("at", in_block).join(offsets, ["file_path", "block"])
    return numbered.select(
        F.regexp_extract(place, r"([^/]+)/logs/[^/]+\.log\z", 1).alias("run_id"),
        F.regexp_extract(place, r"([^/]+)\.log\z", 1).alias("stream"),
        (F.col("before") + F.col("at")).alias("line_no"),
        "line",
    )


def read_code_tree(spark: SparkSession, path: str) -> DataFrame:
    """``<path>/<project_id>/...`` trees as code files, with their text in UTF-8.

    Bytes that are no UTF-8 become replacement characters, as they do in archives, so that a
    binary file among the code is a row like others. Spark's file listing skips names that start with a dot or an underscore; trees that
    have such files are landed as archives and read with ``read_code_archives``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )
    below = F.regexp_extract("path", _inside(path), 1)
    return files.select(
        F.regexp_extract(below, r"\A([^/]+)/", 1).alias("project_id"),
        F.lit(None).cast("string").alias("entry_file"),
        F.regexp_replace(below, r"\A[^/]+/", "").alias("rel_path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def read_code_archives(spark: SparkSession, path: str) -> DataFrame:
    """``<path>/.../<project_id>.tar.gz`` as code files; every archive is unpacked in a task.

    An archive that cannot be read, or that has no files, is one row without a path.
    """

    def files(content: bytes) -> Iterator[tuple[str, str]]:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
            for member in archive:
                if member.isfile():
                    text = archive.extractfile(member).read().decode("utf-8", "replace")
                    yield member.name.removeprefix("./"), text

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for project, content in zip(frame["project_id"], frame["content"]):
                found: list[tuple[str | None, str | None]]
                try:
                    found = list(files(content))
                except (tarfile.TarError, EOFError, OSError, zlib.error):
                    found = []
                names, texts = zip(*(found or [(None, None)]))
                yield pd.DataFrame(
                    {"project_id": project, "entry_file": None, "rel_path": names, "content": texts}
                )

    archives = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.tar.gz")
        .load(path)
        .select(F.regexp_extract("path", r"([^/]+)\.tar\.gz\z", 1).alias("project_id"), "content")
    )
    return archives.mapInPandas(unpack, CODE_FILES)


def read_polls(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Landed polls as JSON lines, as a batch or as a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("run_id string, poll_ts timestamp, raw_status string").json(path)
