"""Layered run settings and the templates inside them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.functions import text as X


def clean_overrides(settings: DataFrame, override_layer: int = C.OVERRIDE_LAYER) -> DataFrame:
    """Override rows with friendly names mapped to setting names, and blank ones dropped.

    Other layers pass unchanged: a file may set an empty string, an override may not.
    """
    is_override = F.coalesce(F.col("layer") == override_layer, F.lit(False))
    name = F.col("key")
    renamed = name
    for alias, target in C.SETTING_ALIASES.items():
        renamed = F.when(name == alias, F.lit(target)).otherwise(renamed)
    blank = F.col("value").isNull() | (F.col("value") == "")
    return settings.filter(~(is_override & blank)).withColumn(
        "key", F.when(is_override, renamed).otherwise(name)
    )


def overlay_settings(settings: DataFrame) -> DataFrame:
    """One row per run with every setting taken from its highest layer, else its default.

    Within a layer the entry with the larger ``seq`` counts. Unknown keys and nulls change
    nothing, but their run has its row. A row without a key stands for settings that could not
    be read, and gives a ``reject_reason``, as does a text that is no value of its
    setting's type; that setting has its default.

    All settings are picked in one grouping by run, reduced per task ahead of its one shuffle.
    Its aggregates hold texts, so Spark sorts each task's rows for it; telling apart 26
    settings by hash would take a second shuffle.
    """
    runs = settings.groupBy("run_id").agg(
        *(
            F.expr(
                f"max(CASE WHEN key = '{name}' AND value IS NOT NULL THEN struct(layer, seq, value) END).value"
            ).alias(name)
            for name in C.SETTING_NAMES
        ),
        F.max(F.col("key").isNull()).alias("_unread"),
    )
    columns, complaints = [], []
    for name, kind, default in C.SETTINGS:
        value = name if kind == "string" else f"try_cast({name} AS {kind})"
        columns.append(F.coalesce(F.expr(value), F.lit(default).cast(kind)).alias(name))
        if kind != "string":
            bad = f"CASE WHEN {name} IS NOT NULL AND {value} IS NULL THEN '{name} is not a {kind}' END"
            complaints.append(F.expr(bad))
    complaints.append(F.when(F.col("_unread"), F.lit("settings of a layer cannot be read")))
    return runs.select("run_id", *columns, F.coalesce(*complaints).alias("reject_reason"))


def expand_templates(
    configs: DataFrame,
    variables: Mapping[str, str] | None = None,
    *,
    config_dir: str = "",
    cwd: str = "",
) -> DataFrame:
    """Variables, then ``{key}`` templates, filled into every string setting.

    The model id and slug offered to the templates are those before expansion. Texts
    without a marker skip the work.
    """
    values = F.create_map(
        F.lit("config_dir"), F.lit(config_dir),
        F.lit("cwd"), F.lit(cwd),
        F.lit("model_id"), F.col("model_id"),
        F.lit("model_slug"), X.model_slug(F.col("model_id")),
        F.lit("run_id"), F.col("run_id"),
        F.lit("timestamp"), F.col("run_id"),
    )

    def filled(name: str) -> Column:
        text = F.col(name)
        expanded = X.expand_keys(X.expand_variables(text, variables or {}), F.col("_values"))
        return F.when(text.rlike(r"[${}]"), expanded).otherwise(text).alias(name)

    strings = [name for name in C.STRING_SETTINGS if name in configs.columns]
    # The values are a column of their own: inside a lambda, a name that the same select
    # gives out anew would mean the new column.
    return configs.withColumn("_values", values).select(
        *(filled(name) if name in strings else F.col(name) for name in configs.columns)
    )
