"""Memory estimates and the GPUs that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.constants import GPU_CATALOG, GpuType
from slipway.functions import models as M
from slipway.functions import pricing as P
from slipway.functions.numbers import round_cents, round_columns
from slipway.functions.text import strip
from slipway.operators.sizing import resolve_specs


def with_scenarios(specs: DataFrame, scenarios: Sequence[tuple[str, int | None, int]]) -> DataFrame:
    """Each spec once per (goal, context length or None, batch size); no join, no shuffle."""
    choices = F.array(
        *(
            F.struct(
                F.lit(goal).alias("goal"),
                F.lit(context).cast("bigint").alias("context_len"),
                F.lit(batch).cast("bigint").alias("batch_size"),
            )
            for goal, context, batch in scenarios
        )
    )
    return specs.withColumn("_s", F.explode(choices)).select(*specs.columns, "_s.*")


def estimate_memory(requests: DataFrame) -> DataFrame:
    """VRAM, host RAM and disk for spec rows that carry goal, context_len and batch_size.

    Every step is row-local. Rows with an unknown goal, or whose spec was rejected, keep
    their place with a ``reject_reason`` and null numbers.
    """
    goal = F.col("goal")
    training = F.lit(C.DEFAULT_TRAINING_CONTEXT)
    default_context = F.when(goal == "inference", F.lit(C.DEFAULT_INFERENCE_CONTEXT)).otherwise(training)
    longest = F.when(F.col("max_context") > 0, F.col("max_context"))
    spec_reason = F.col("reject_reason") if "reject_reason" in requests.columns else F.lit(None)
    base = requests.withColumn("goal", F.lower(strip(goal))).select(
        "model_id",
        "goal",
        "param_count",
        F.coalesce(F.col("context_len"), F.least(default_context, longest))
        .cast("bigint")
        .alias("context_len"),
        F.coalesce(F.col("batch_size"), F.lit(1)).cast("bigint").alias("batch_size"),
        "hidden_size",
        "num_layers",
        "num_kv_heads",
        "head_dim",
        "source",
        M.gib(F.col("weight_bytes")).alias("checkpoint_gb"),
        F.least(
            M.stored_bytes_per_param(F.col("weight_bytes"), F.col("param_count")), F.lit(2.0)
        ).alias("compute_bytes"),
        F.coalesce(
            spec_reason.cast("string"),
            F.when(~goal.isin(*C.GOALS), F.concat(F.lit("unsupported goal: "), goal)),
            F.when(goal.isNull(), F.lit("unsupported goal: none")),
        ).alias("reject_reason"),
    )

    def columns(*names: str) -> list[Column]:
        return [F.col(name) for name in names]

    params, layers = columns("param_count", "num_layers")
    length = columns("context_len", "batch_size")
    is_inference, is_full, is_lora = (goal == name for name in ("inference", "full", "lora"))
    adapter = params * F.lit(C.LORA_TRAINABLE_FRACTION) * F.lit(C.FULL_BYTES_PER_PARAM)
    parts = base.select(
        "*",
        F.when(is_inference, F.col("checkpoint_gb"))
        .when(is_full | is_lora, M.gib(params * F.col("compute_bytes")))
        .otherwise(M.gib(params * F.lit(C.QLORA_BYTES_PER_PARAM)))
        .alias("weights_gb"),
        F.when(is_inference, M.kv_cache_gb(layers, *columns("num_kv_heads", "head_dim"), *length))
        .otherwise(F.lit(0.0))
        .alias("kv_cache_gb"),
        F.when(is_inference, F.lit(0.0))
        .otherwise(M.activations_gb(F.col("hidden_size"), layers, params, *length))
        .alias("activations_gb"),
        F.when(is_inference, F.lit(0.0))
        .when(is_full, M.gib(params * (F.lit(C.FULL_BYTES_PER_PARAM) - F.col("compute_bytes"))))
        .otherwise(M.gib(adapter))
        .alias("optimizer_gb"),
    )
    share = F.when(goal == "qlora", F.lit(0.15)).otherwise(F.lit(0.1))
    weights, optimizer = F.col("weights_gb"), F.col("optimizer_gb")
    overhead = F.when(is_full, F.lit(0.1) * (weights + optimizer)).otherwise(
        F.greatest(F.lit(1.0), share * weights)
    )
    total = weights + F.col("kv_cache_gb") + F.col("activations_gb") + optimizer + F.col("overhead_gb")
    totals = parts.withColumn("overhead_gb", overhead).withColumn("total_vram_gb", total)
    sizes = ("weights_gb", "kv_cache_gb", "activations_gb", "optimizer_gb", "total_vram_gb")
    rounded = round_columns(totals, *sizes)
    known = M.has_architecture(F.col("num_layers"), F.col("num_kv_heads"), F.col("head_dim"))
    ram_factor = F.when(is_full, F.lit(2.0)).otherwise(F.lit(1.5))
    disk_factor = F.when(is_full | is_lora, F.lit(4.0)).otherwise(F.lit(2.5))

    def kept(value: Column) -> Column:
        return F.when(F.col("reject_reason").isNull(), value)

    def at_least(minimum: int, factor: Column) -> Column:
        return F.greatest(F.lit(minimum).cast("bigint"), F.ceil(F.col("checkpoint_gb") * factor))

    return rounded.select(
        "model_id",
        "goal",
        "param_count",
        "context_len",
        "batch_size",
        *(kept(F.col(name)).alias(name) for name in sizes),
        kept(at_least(16, ram_factor)).alias("host_ram_gb"),
        kept(at_least(50, disk_factor)).alias("disk_gb"),
        kept(M.estimate_notes(F.col("source"), known, goal)).alias("notes"),
        "reject_reason",
    )


def gpu_fit_table(
    estimates: DataFrame,
    cloud_type: str | Column = "COMMUNITY",
    catalog: Sequence[GpuType] = GPU_CATALOG,
    splits: Sequence[int] = C.GPU_SPLITS,
) -> DataFrame:
    """Every estimate spread over 1, 2, 4 and 8 GPUs with the cheapest GPU that fits.

    The price list is short, so the choice is a chain of comparisons in generated code
    rather than a join. Splits that nothing fits keep their row with nulls.
    """
    entries = P.checked_catalog(catalog)
    cloud = F.lit(cloud_type) if isinstance(cloud_type, str) else cloud_type
    rows = estimates.withColumn("num_gpus", F.explode(F.array(*[F.lit(n) for n in splits])))
    needed = rows.withColumn(
        "min_vram_per_gpu_gb", M.min_vram_gb(F.col("total_vram_gb"), F.col("num_gpus"))
    )
    chosen = needed.withColumn("_fit", P.cheapest_fit(F.col("min_vram_per_gpu_gb"), cloud, entries))
    return chosen.select(
        *needed.columns,
        F.col("_fit.gpu_id").alias("cheapest_gpu"),
        round_cents(F.col("_fit.hourly") * F.col("num_gpus")).alias("estimated_dollars_per_hour"),
    )


def estimate_for_model(
    tensor_counts: DataFrame,
    model_files: DataFrame,
    model_configs: DataFrame,
    scenarios: Sequence[tuple[str, int | None, int]],
) -> DataFrame:
    """Memory estimates of every model straight from the landed metadata tables."""
    specs = resolve_specs(tensor_counts, model_files, model_configs)
    return estimate_memory(with_scenarios(specs, scenarios))
