"""Volume decisions and whole run plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.constants import GPU_CATALOG, GpuType
from slipway.functions import models as M
from slipway.functions import text as X
from slipway.functions.joins import lookup_join
from slipway.operators.code import verify_projects
from slipway.operators.offers import gpu_type_ids, top_offers


def plan_volume(
    configs: DataFrame, sizes: DataFrame, volumes: DataFrame, *, name_prefix: str = "job-"
) -> DataFrame:
    """Each config with what to do about its network volume.

    ``volume_action`` is none, use (an id was given), reuse (same name and data center
    exist), create or error (no data center named). Model sizes and volumes are looked up
    with salted joins, so a popular model or a shared volume name is no hot task.
    """
    supported = X.normalize_provider(F.col("provider")) == C.PROVIDERS[0]
    given = X.strip(F.col("network_volume_id"))
    auto = F.coalesce(F.col("auto_network_volume"), F.lit(False))
    wanted = F.when(F.col("network_volume_size_gb") != 0, F.col("network_volume_size_gb"))
    slug_name = F.concat(F.lit(name_prefix), X.model_slug(F.col("model_id")))
    asked = configs.select(
        *configs.columns,
        F.coalesce(supported, F.lit(False)).alias("_supported"),
        # Runs that need no size get keys of their own, which match nothing and spread evenly.
        F.coalesce(
            F.when(supported & auto & wanted.isNull() & (F.col("model_id") != ""), F.col("model_id")),
            F.concat(F.lit("\0"), F.col("run_id")),
        ).alias("_model"),
        F.when(supported & auto & (given == ""), F.lit(True)).alias("_auto"),
        F.coalesce(F.nullif(F.col("network_volume_name"), F.lit("")), slug_name).alias("_name"),
        F.col("network_volume_data_center_id").alias("_center"),
    )
    model_sizes = sizes.select(F.col("model_id").alias("_model"), F.col("size_gb").alias("_size"))
    first_volume = (
        volumes.groupBy(F.col("name").alias("_name"), F.col("data_center_id").alias("_center"))
        .agg(F.min(F.struct("seq", "volume_id")).alias("_volume"))
        .select("_name", "_center", F.col("_volume.volume_id").alias("_found"))
    )
    sized = lookup_join(asked, model_sizes, ["_model"], ["run_id"])
    found = lookup_join(sized, first_volume, ["_name", "_center"], ["run_id"])
    plan_size = F.when(
        F.col("_auto"),
        F.coalesce(
            wanted.cast("bigint"),
            M.suggest_volume_gb(F.col("_size"), fallback=F.col("pod_volume_gb")),
        ),
    ).otherwise(F.when(F.col("_supported"), F.col("network_volume_size_gb").cast("bigint")))
    action = (
        F.when(~F.col("_supported"), F.lit("none"))
        .when(given != "", F.lit("use"))
        .when(~auto, F.lit("none"))
        .when(X.strip(F.col("_center")) == "", F.lit("error"))
        .when(F.col("_found").isNotNull(), F.lit("reuse"))
        .otherwise(F.lit("create"))
    )
    decided = found.withColumn("volume_action", action).withColumn("plan_volume_size_gb", plan_size)
    creating = F.col("volume_action") == "create"
    return decided.select(
        *configs.columns,
        "volume_action",
        F.when(F.col("volume_action") == "use", given)
        .when(F.col("volume_action") == "reuse", F.col("_found"))
        .alias("volume_id"),
        F.when(creating, F.left(F.col("_name"), F.lit(C.VOLUME_NAME_MAX_CHARS))).alias("volume_name"),
        F.when(
            creating,
            F.coalesce(
                F.when(F.col("plan_volume_size_gb") != 0, F.col("plan_volume_size_gb")),
                F.col("pod_volume_gb").cast("bigint"),
            ),
        ).alias("volume_size_gb"),
        F.col("_size").alias("model_size_gb"),
        "plan_volume_size_gb",
        X.volume_ignored(F.col("provider"), auto, F.col("network_volume_id")).alias("volume_options_ignored"),
    )


def make_plan(
    configs: DataFrame,
    code_files: DataFrame,
    offers: DataFrame,
    sizes: DataFrame,
    volumes: DataFrame,
    *,
    catalog: Sequence[GpuType] = GPU_CATALOG,
    run_root: str = C.RUN_ROOT,
) -> DataFrame:
    """One plan per run config; a run that cannot be planned keeps its row and the reason.

    ``configs`` holds run_id and all settings, ``code`` naming a project of ``code_files``.
    """
    projects = verify_projects(code_files, run_root).withColumnRenamed("project_id", "code")
    checked = lookup_join(configs, projects, ["code"], ["run_id"])
    provider = X.normalize_provider(F.col("provider"))
    priced = gpu_type_ids(checked.withColumn("_provider", provider), catalog)
    matched = top_offers(
        priced.withColumnsRenamed(
            {"gpu_type_ids": "_listed_ids", "estimated_hourly_dollars": "_listed_hourly"}
        ),
        offers,
        C.OFFERS_PER_PLAN,
        only=F.col("_provider") == C.PROVIDERS[1],
    )
    listed = F.col("_provider") == C.PROVIDERS[0]
    planned = plan_volume(matched, sizes, volumes)
    own_command = F.nullif(X.strip(F.col("command")), F.lit(""))
    command = F.coalesce(own_command, F.col("default_command"))
    candidates = F.when(listed, F.col("_listed_ids")).when(
        F.col("_provider") == C.PROVIDERS[1], F.col("offer_labels")
    )
    capped = F.col("max_dollars_per_hour") > 0
    need = F.concat_ws(
        "",
        F.greatest(F.lit(1), F.col("gpu_count")),
        F.lit(" x "),
        F.col("vram_gb"),
        F.lit(" GB"),
        F.when(capped, F.concat(F.lit(" within "), F.format_string("%.2f", "max_dollars_per_hour"))),
    )
    setting_reason = F.col("reject_reason") if "reject_reason" in configs.columns else F.lit(None).cast("string")
    reason = F.coalesce(
        setting_reason,
        F.when(F.col("code") == "", F.lit("no code is named")),
        F.when(F.col("checked_files").isNull(), F.concat(F.lit("no such code: "), F.col("code"))),
        F.when(command.isNull(), F.col("command_error")),
        F.when(F.col("error_files") > 0, F.concat(F.lit("code has errors: "), F.col("first_error"))),
        F.when(F.col("_provider").isNull(), F.concat(F.lit("unknown provider: "), F.col("provider"))),
        F.when(F.size(candidates) == 0, F.concat(F.lit("nothing on offer for "), need)),
    )
    return planned.withColumn("_reason", reason).select(
        "run_id",
        "model_id",
        F.col("code").alias("code_path"),
        F.col("_provider").alias("provider"),
        command.alias("command"),
        candidates.alias("gpu_candidates"),
        F.when(listed, F.col("_listed_hourly"))
        .otherwise(F.col("estimated_hourly_dollars"))
        .alias("estimated_hourly_dollars"),
        "max_spend_dollars",
        "model_size_gb",
        F.when(F.col("_provider") == C.PROVIDERS[0], X.strip(F.col("network_volume_id")))
        .otherwise(F.lit(""))
        .alias("network_volume_id"),
        F.col("plan_volume_size_gb").alias("network_volume_size_gb"),
        F.concat(F.col("results_dir"), F.lit("/"), F.col("run_id")).alias("results_dir"),
        F.coalesce(F.col("checked_files"), F.lit(0).cast("bigint")).alias("verified_file_count"),
        F.coalesce(F.col("checked_paths"), F.array().cast("array<string>")).alias("verified_files"),
        "volume_action",
        "volume_id",
        "volume_name",
        "volume_size_gb",
        "volume_options_ignored",
        F.col("_reason").alias("reject_reason"),
    )


def plan_summary(plans: DataFrame) -> DataFrame:
    """The columns shown for a plan, for runs that could be planned."""
    return plans.filter(F.col("reject_reason").isNull()).select(
        "run_id",
        "model_id",
        "code_path",
        "command",
        "gpu_candidates",
        "estimated_hourly_dollars",
        "max_spend_dollars",
        "model_size_gb",
        "network_volume_id",
        "network_volume_size_gb",
        "results_dir",
        "verified_files",
    )
