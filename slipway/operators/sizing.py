"""Weight sizes, parameter counts, architectures and the specs made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.functions import models as M

_SHAPE = ("hidden_size", "num_layers", "num_kv_heads", "head_dim", "max_context")


def _file_bytes(model_files: DataFrame) -> DataFrame:
    """Bytes every file adds to its model, as whole GiB and the rest.

    Both parts add up exactly and far from the limits of a 64-bit sum, however many files a
    model has. The name is put in lower case once, not per suffix.
    """
    named = model_files.withColumn("_name", F.lower("file_name"))
    counted = named.select(
        "model_id", M.weight_file_bytes(F.col("_name"), F.col("size_bytes")).alias("_bytes")
    )
    return counted.select(
        "model_id",
        F.shiftright("_bytes", 30).alias("file_gib"),
        F.col("_bytes").bitwiseAND(F.lit(C.GIB - 1)).alias("file_rest"),
    )


def _size_gb(file_gib: Column, file_rest: Column) -> Column:
    return F.when((file_gib > 0) | (file_rest > 0), file_gib + M.gib(file_rest))


def weight_file_rollup(model_files: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Size of every model's weight files in GiB.

    A model without weight files keeps its row with a null size. Models named in
    ``models`` but without any file listing come out as ``unavailable``. One shuffle,
    with partial sums first, so a model with very many files is no bottleneck.
    """
    rows = _file_bytes(model_files).withColumn("listed", F.lit(1))
    if models is not None:
        none = F.lit(0).cast("bigint")
        asked = models.select("model_id", none.alias("file_gib"), none.alias("file_rest"), F.lit(0).alias("listed"))
        rows = rows.unionByName(asked)
    totals = rows.groupBy("model_id").agg(
        F.sum("file_gib").alias("file_gib"),
        F.sum("file_rest").alias("file_rest"),
        F.max("listed").alias("listed"),
    )
    return totals.select(
        "model_id",
        _size_gb(F.col("file_gib"), F.col("file_rest")).alias("size_gb"),
        F.when(F.col("listed") == 1, F.lit("metadata")).otherwise(F.lit("unavailable")).alias("source"),
    )


def suggest_volume_gb(
    sizes: DataFrame,
    multiplier: float = C.VOLUME_MULTIPLIER,
    minimum: int = C.VOLUME_MINIMUM_GB,
    fallback: int = C.VOLUME_FALLBACK_GB,
) -> DataFrame:
    """``sizes`` plus the volume to reserve for each model."""
    return sizes.withColumn(
        "suggested_network_volume_gb",
        M.suggest_volume_gb(F.col("size_gb"), multiplier, minimum, fallback),
    )


def model_size_report(model_files: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Model, size, source of the size and suggested volume."""
    return suggest_volume_gb(weight_file_rollup(model_files, models)).select(
        F.col("model_id").alias("model"), "size_gb", "source", "suggested_network_volume_gb"
    )


def _tensor_bytes(tensor_counts: DataFrame) -> DataFrame:
    """Parameters and half bytes of every tensor row; the tag is put in upper case once.

    A product beyond 64 bits is null and shows as a missing width in the counts.
    """
    tagged = tensor_counts.select(
        "model_id",
        F.coalesce(F.col("param_count"), F.lit(0)).alias("param_count"),
        F.upper("dtype").alias("_tag"),
    )
    return tagged.select(
        "model_id",
        "param_count",
        F.try_multiply(F.col("param_count"), M.half_bytes_per_param(F.col("_tag"))).alias("half_bytes"),
    )


# Sums that give null instead of failing the job when one model's counts pass 64 bits.
_COUNT_SUMS = (
    ("params", F.try_sum, "param_count"),
    ("half_bytes", F.try_sum, "half_bytes"),
    ("tensors", F.count, "param_count"),
    ("widths", F.count, "half_bytes"),
)


def _counts() -> list[Column]:
    return [function(column).alias(name) for name, function, column in _COUNT_SUMS]


def _too_large() -> Column:
    params, half_bytes, tensors, widths = (F.col(name) for name, _, _ in _COUNT_SUMS)
    return (tensors > 0) & (params.isNull() | half_bytes.isNull() | (widths < tensors))


def param_rollup(tensor_counts: DataFrame) -> DataFrame:
    """Parameters and weight bytes per model; models without positive counts have none.

    Widths are summed in half bytes as integers, so 4-bit types add up exactly and in any
    order; the odd half byte is cut at the end. A model whose counts pass 64 bits keeps its
    row with nulls.
    """
    totals = _tensor_bytes(tensor_counts).groupBy("model_id").agg(*_counts())
    fits = ~_too_large()
    return totals.filter(_too_large() | (F.col("params") > 0)).select(
        "model_id",
        F.when(fits, F.col("params")).alias("param_count"),
        F.when(fits, F.expr("half_bytes div 2")).alias("weight_bytes"),
    )


_CONFIG_KEYS = {
    "hidden_size": C.HIDDEN_KEYS,
    "num_layers": C.LAYER_KEYS,
    "heads": C.ATTENTION_HEAD_KEYS,
    "kv_heads": C.KV_HEAD_KEYS,
    "own_head_dim": C.HEAD_DIM_KEYS,
    "max_context": C.MAX_CONTEXT_KEYS,
}


def config_numbers(model_configs: DataFrame) -> DataFrame:
    """The first valid number of every group of config keys.

    Parsing, picking, reading and checking are separate steps. So a text is parsed once, an
    entry picked once, and the generated methods stay short enough for the JVM to compile.
    """
    keys = [key for group in _CONFIG_KEYS.values() for key in group]
    document, text = F.col("_document"), F.col("_text")
    parsed = model_configs.select("model_id", F.try_parse_json("config_json").alias("_document"))
    nested = parsed.withColumn("_text", F.try_variant_get(document, "$.text_config", "variant"))
    entries = nested.select(
        "model_id", *(M.config_entry(document, text, key).alias(f"_{key}") for key in keys)
    )
    numbers = entries.select("*", *(M.variant_number(F.col(f"_{key}")).alias(f"_n_{key}") for key in keys))

    def first(group: tuple[str, ...]) -> Column:
        return F.coalesce(*(M.positive_int(F.col(f"_{key}"), F.col(f"_n_{key}")) for key in group))

    return numbers.select(
        "model_id", *(first(group).alias(name) for name, group in _CONFIG_KEYS.items())
    )


def extract_architecture(model_configs: DataFrame) -> DataFrame:
    """The five architecture numbers of every model config."""
    return config_numbers(model_configs).select(
        "model_id",
        "hidden_size",
        "num_layers",
        M.kv_heads_or_attention(F.col("kv_heads"), F.col("heads")).alias("num_kv_heads"),
        M.head_dim_or_split(F.col("own_head_dim"), F.col("hidden_size"), F.col("heads")).alias("head_dim"),
        "max_context",
    )


def resolve_specs(
    tensor_counts: DataFrame, model_files: DataFrame, model_configs: DataFrame
) -> DataFrame:
    """One spec row per model seen in any of the three tables.

    Counts come from the tensor metadata, else from the weight files at two bytes per
    parameter; a model with neither keeps its row with a ``reject_reason``. The tables are
    stacked and grouped once instead of being joined in pairs: one shuffle, with partial
    aggregation. ``model_configs`` holds one row per model.
    """
    no_number = F.lit(None).cast("bigint")

    def row(frame: DataFrame, *own: str) -> DataFrame:
        columns = ("param_count", "half_bytes", "file_gib", "file_rest", *_SHAPE)
        return frame.select(
            "model_id", *(F.col(name) if name in own else no_number.alias(name) for name in columns)
        )

    stacked = (
        row(_tensor_bytes(tensor_counts), "param_count", "half_bytes")
        .unionByName(row(_file_bytes(model_files), "file_gib", "file_rest"))
        .unionByName(row(extract_architecture(model_configs), *_SHAPE))
    )
    facts = stacked.groupBy("model_id").agg(
        *_counts(),
        F.sum("file_gib").alias("file_gib"),
        F.sum("file_rest").alias("file_rest"),
        *(F.max(name).alias(name) for name in _SHAPE),
    )
    file_bytes = F.try_add(
        F.try_multiply(F.col("file_gib"), F.lit(C.GIB).cast("bigint")), F.col("file_rest")
    )
    resolved = facts.select(
        "model_id",
        "params",
        "half_bytes",
        *_SHAPE,
        _too_large().alias("too_many"),
        (~_too_large() & F.coalesce(F.col("params") > 0, F.lit(False))).alias("counted"),
        _size_gb(F.col("file_gib"), F.col("file_rest")).isNotNull().alias("sized"),
        file_bytes.alias("file_bytes"),
    )
    counted, sized, too_many = F.col("counted"), F.col("sized"), F.col("too_many")
    by_size = ~counted & ~too_many & F.col("file_bytes").isNotNull() & sized
    return resolved.select(
        "model_id",
        F.when(counted, F.col("params")).when(by_size, F.expr("file_bytes div 2")).alias("param_count"),
        F.when(counted, F.expr("half_bytes div 2")).when(by_size, F.col("file_bytes")).alias("weight_bytes"),
        *_SHAPE,
        F.when(counted, F.lit("safetensors")).when(by_size, F.lit("file-size")).alias("source"),
        F.when(too_many | (~counted & sized & ~by_size), F.lit("counts pass 64 bits"))
        .when(~counted & ~sized, F.lit("no safetensors metadata and no weight files found"))
        .alias("reject_reason"),
    )
