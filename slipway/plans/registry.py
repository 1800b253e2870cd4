"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipway.functions import text as X
from slipway.operators import code, logs, memory, offers, planning, settings, sizing, telemetry
from slipway.plans import bindings as B
from slipway.session import shared_dir
from slipway.streaming import outcomes, timers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SCENARIOS = (
    ("inference", None, 1),
    ("inference", 32768, 8),
    ("lora", None, 1),
    ("qlora", None, 2),
    ("full", 4096, 1),
)
LISTED_REQUEST = {"min_vram_gb": 24, "max_dollars_per_hour": 9.0, "cloud_type": "SECURE", "gpu_count": 1}
PINNED = "NVIDIA L4, NVIDIA H200,NVIDIA B200"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(name: str, mark: str = "|") -> F.Column:
    return F.array_join(name, mark).alias(name)


# Model sizing


@query
def weight_file_rollup(spark, sf_dir):
    files = B.MODEL_FILES.frame(spark, sf_dir)
    return sizing.weight_file_rollup(files, B.ASKED_MODELS.frame(spark, sf_dir))


@query
def suggest_volume_gb(spark, sf_dir):
    sizes = sizing.weight_file_rollup(B.MODEL_FILES.frame(spark, sf_dir))
    return sizing.suggest_volume_gb(sizes, multiplier=3.5, minimum=20, fallback=90)


@query
def model_size_report(spark, sf_dir):
    return sizing.model_size_report(B.MODEL_FILES.frame(spark, sf_dir))


@query
def param_rollup(spark, sf_dir):
    return sizing.param_rollup(B.TENSOR_COUNTS.frame(spark, sf_dir))


@query
def extract_architecture(spark, sf_dir):
    return sizing.extract_architecture(B.MODEL_CONFIGS.frame(spark, sf_dir))


@query
def resolve_specs(spark, sf_dir):
    return sizing.resolve_specs(
        B.TENSOR_COUNTS.frame(spark, sf_dir),
        B.MODEL_FILES.frame(spark, sf_dir),
        B.MODEL_CONFIGS.frame(spark, sf_dir),
    )


@query
def estimate_memory(spark, sf_dir):
    estimates = memory.estimate_memory(B.MODEL_SPECS.frame(spark, sf_dir))
    return estimates.withColumn("notes", F.array_join("notes", "; "))


@query
def gpu_fit_table(spark, sf_dir):
    estimates = memory.estimate_memory(B.MODEL_SPECS.frame(spark, sf_dir))
    fits = memory.gpu_fit_table(estimates, "SECURE")
    return fits.select(
        "model_id", "goal", "num_gpus", "min_vram_per_gpu_gb", "cheapest_gpu", "estimated_dollars_per_hour"
    )


@query
def estimate_for_model(spark, sf_dir):
    """Landed metadata of every model to memory needs and the cheapest fitting GPUs."""
    estimates = memory.estimate_for_model(
        B.TENSOR_COUNTS.frame(spark, sf_dir),
        B.MODEL_FILES.frame(spark, sf_dir),
        B.MODEL_CONFIGS.frame(spark, sf_dir),
        SCENARIOS,
    )
    fits = memory.gpu_fit_table(estimates, "COMMUNITY")
    return fits.withColumn("notes", F.array_join("notes", "; "))


# Offer matching


@query
def candidate_gpus(spark, sf_dir):
    return offers.candidate_gpus(B.RUN_REQUESTS.frame(spark, sf_dir))


@query
def gpu_type_ids(spark, sf_dir):
    found = offers.gpu_type_ids(B.RUN_REQUESTS.frame(spark, sf_dir))
    return found.select("run_id", _joined("gpu_type_ids"), "estimated_hourly_dollars")


@query
def estimated_hourly(spark, sf_dir):
    quotes = B.GPU_QUOTES.frame(spark, sf_dir)
    return offers.estimated_hourly(quotes, planned_hourly=F.col("planned_hourly"))


@query
def price_offers(spark, sf_dir):
    priced = offers.price_offers(B.GPU_OFFERS.frame(spark, sf_dir))
    return priced.select("cloud_id", "label", "hourly", "pod_hourly")


@query
def list_offers(spark, sf_dir):
    listed = offers.list_offers(B.GPU_OFFERS.frame(spark, sf_dir), **LISTED_REQUEST)
    return listed.select("cloud_id", "gpu_memory", "hourly", "label", "data_center")


@query
def top_offers(spark, sf_dir):
    best = offers.top_offers(B.RUN_REQUESTS.frame(spark, sf_dir), B.GPU_OFFERS.frame(spark, sf_dir))
    return best.select("run_id", _joined("offer_labels"), "estimated_hourly_dollars")


@query
def select_image(spark, sf_dir):
    rows = B.GPU_OFFERS.frame(spark, sf_dir)
    asked = F.when(F.length("cloud_id") % 2 == 0, F.lit("runpod/pytorch:2.8")).otherwise(
        F.when(F.col("gpu_count") == 4, F.lit(" ubuntu_26 ")).otherwise(F.lit(""))
    )
    return offers.select_image(rows, asked).select("cloud_id", "image")


@query
def clamp_disk(spark, sf_dir):
    rows = offers.clamp_disk(B.GPU_OFFERS.frame(spark, sf_dir), 120)
    return rows.select("cloud_id", "disk_gb")


@query
def pin_gpus(spark, sf_dir):
    plans = offers.gpu_type_ids(B.RUN_REQUESTS.frame(spark, sf_dir))
    return offers.pin_gpus(plans, PINNED).select("run_id", _joined("gpu_type_ids"))


# Planning


@query
def clean_overrides(spark, sf_dir):
    return settings.clean_overrides(B.SETTINGS.frame(spark, sf_dir))


@query
def overlay_settings(spark, sf_dir):
    return settings.overlay_settings(settings.clean_overrides(B.SETTINGS.frame(spark, sf_dir)))


@query
def expand_templates(spark, sf_dir):
    return settings.expand_templates(
        B.TEMPLATES.frame(spark, sf_dir),
        B.TEMPLATE_VARIABLES,
        config_dir=B.TEMPLATE_CONFIG_DIR,
        cwd=B.TEMPLATE_CWD,
    )


@query
def model_slugs(spark, sf_dir):
    return B.MODEL_NAMES.frame(spark, sf_dir).withColumn("slug", X.model_slug(F.col("model_id")))


@query
def infer_command(spark, sf_dir):
    return code.infer_command(B.CODE_FILES.frame(spark, sf_dir))


@query
def select_code_files(spark, sf_dir):
    return code.select_code_files(B.CODE_FILES.frame(spark, sf_dir)).select("project_id", "rel_path")


@query
def select_bundle_files(spark, sf_dir):
    return code.select_bundle_files(B.CODE_FILES.frame(spark, sf_dir)).select("project_id", "rel_path")


@query
def check_syntax(spark, sf_dir):
    checked = code.check_syntax(B.CODE_FILES.frame(spark, sf_dir))
    return checked.select("project_id", "rel_path", "state")


@query
def verify_projects(spark, sf_dir):
    verified = code.verify_projects(B.CODE_FILES.frame(spark, sf_dir))
    return verified.drop("first_error").withColumn("checked_paths", F.array_join("checked_paths", "|"))


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.expand_templates(
        overlay_settings(spark, sf_dir),
        B.TEMPLATE_VARIABLES,
        config_dir=B.TEMPLATE_CONFIG_DIR,
        cwd=B.TEMPLATE_CWD,
    )


@query
def plan_volume(spark, sf_dir):
    planned = planning.plan_volume(
        _configs(spark, sf_dir),
        sizing.weight_file_rollup(B.MODEL_FILES.frame(spark, sf_dir)),
        B.VOLUMES.frame(spark, sf_dir),
    )
    return planned.select(
        "run_id",
        "volume_action",
        "volume_id",
        "volume_name",
        "volume_size_gb",
        "plan_volume_size_gb",
        "model_size_gb",
        "volume_options_ignored",
    )


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.make_plan(
        _configs(spark, sf_dir),
        B.CODE_FILES.frame(spark, sf_dir),
        B.GPU_OFFERS.frame(spark, sf_dir),
        sizing.weight_file_rollup(B.MODEL_FILES.frame(spark, sf_dir)),
        B.VOLUMES.frame(spark, sf_dir),
    )


@query
def make_plan(spark, sf_dir):
    """All columns; of a compiler's complaint only that there is one."""
    plans = _plans(spark, sf_dir)
    return plans.withColumns(
        {
            "gpu_candidates": F.array_join("gpu_candidates", "|"),
            "verified_files": F.array_join("verified_files", "|"),
            "reject_reason": F.regexp_replace("reject_reason", "(?s)^(code has errors: ).*", "$1"),
        }
    )


@query
def plan_summary(spark, sf_dir):
    summary = planning.plan_summary(_plans(spark, sf_dir))
    return summary.withColumns({name: F.array_join(name, "|") for name in ("gpu_candidates", "verified_files")})


# Run telemetry


_OUTCOME = ("run_id", "outcome", "exit_code", "elapsed_seconds", "spent")


@query
def accrued_spend(spark, sf_dir):
    return telemetry.accrued_spend(B.RUN_POLLS.frame(spark, sf_dir), B.runs(spark, sf_dir)).drop("poll_ts")


@query
def run_outcome(spark, sf_dir):
    ended = telemetry.run_outcome(B.RUN_POLLS.frame(spark, sf_dir), B.runs(spark, sf_dir))
    return ended.select(*_OUTCOME, "pod_kept")


def _event_stream(spark, sf_dir, binding):
    """A binding of the events as a stream of files, and a folder for what comes out."""
    folder = f"{shared_dir(spark)}/outcomes-{uuid.uuid4().hex}"
    events = (
        spark.readStream.schema(B.table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return events.select(*(F.expr(text).alias(name) for name, text in binding.columns.items())), folder


def _streamed(spark, sf_dir):
    """The polls as a stream, the terms of the runs, and a folder for what comes out."""
    polls, folder = _event_stream(spark, sf_dir, B.RUN_POLLS)
    return polls, B.runs(spark, sf_dir), folder


def _run_until_read(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@query
def run_outcome_stream(spark, sf_dir):
    """The polls as a stream, run until all of them are read."""
    polls, terms, folder = _streamed(spark, sf_dir)
    _run_until_read(outcomes.write_decisions(outcomes.decisions(polls, terms), f"{folder}/table", f"{folder}/state"))
    return outcomes.read_outcomes(spark, f"{folder}/table", terms).select(*_OUTCOME)


@query
def spend_alerts(spark, sf_dir):
    polls, terms, folder = _streamed(spark, sf_dir)
    alerts = outcomes.spend_alerts(outcomes.decisions(polls, terms))
    _run_until_read(outcomes.write_decisions(alerts, f"{folder}/table", f"{folder}/state"))
    schema = "run_id string, poll_ts timestamp, elapsed_seconds double, spent double"
    return spark.read.schema(schema).parquet(f"{folder}/table").drop("poll_ts", "batch")


@query
def settled_decisions(spark, sf_dir):
    polls, terms, folder = _streamed(spark, sf_dir)
    settled = outcomes.settled_decisions(polls, terms)
    _run_until_read(outcomes.write_settled(settled, f"{folder}/table", f"{folder}/state"))
    return spark.read.schema(outcomes.DECISION).parquet(f"{folder}/table").drop("poll_ts")


def _micros(earlier, later):
    return F.unix_micros(later) - F.unix_micros(earlier)


def _landed(spark, settled, folder):
    """What a stream in append mode has sent when all its input is read."""
    _run_until_read(outcomes.write_settled(settled, f"{folder}/table", f"{folder}/state"))
    return spark.read.schema(settled.schema).parquet(f"{folder}/table")


@query
def spend_crossings(spark, sf_dir):
    """Alerts at the instant spend reaches its limit, also of runs whose polls have stopped."""
    polls, terms, folder = _streamed(spark, sf_dir)
    found = _landed(spark, timers.spend_crossings(polls, terms), folder)
    return found.select("run_id", _micros("billing_start", "crossed_at").alias("after_us"), "spent")


@query
def readiness_decisions(spark, sf_dir):
    """Pods that became ready, failed or timed out, also those whose snapshots have stopped."""
    snapshots, folder = _event_stream(spark, sf_dir, B.POD_SNAPSHOTS)
    found = _landed(spark, timers.readiness_decisions(snapshots), folder)
    waited = _micros("first_ts", "decided_at").alias("waited_us")
    return found.select("pod_id", "provider", "state", waited, "host", "port")


@query
def spend_guard(spark, sf_dir):
    return telemetry.spend_guard(B.RUN_POLLS.frame(spark, sf_dir), B.runs(spark, sf_dir))


@query
def filter_events(spark, sf_dir):
    return telemetry.filter_events(B.RUN_EVENTS.frame(spark, sf_dir), "error")


@query
def log_tail(spark, sf_dir):
    return logs.log_tail(B.RUN_LOGS.frame(spark, sf_dir))


@query
def failure_events(spark, sf_dir):
    ended = telemetry.run_outcome(B.RUN_POLLS.frame(spark, sf_dir), B.runs(spark, sf_dir))
    return logs.failure_events(B.RUN_LOGS.frame(spark, sf_dir), ended)


@query
def stdout_tail(spark, sf_dir):
    return logs.stdout_tail(logs.split_lines(B.RUN_LOGS.frame(spark, sf_dir)))


@query
def log_entries(spark, sf_dir):
    return logs.log_entries(B.STAMPED_LOGS.frame(spark, sf_dir))


@query
def parse_run_log(spark, sf_dir):
    lines = logs.split_lines(B.RUN_LOGS.frame(spark, sf_dir))
    return logs.parse_run_log(lines.withColumn("line", F.expr(B.LOG_LINE)))


@query
def classify_launch_errors(spark, sf_dir):
    found = telemetry.classify_launch_errors(B.LAUNCH_ERRORS.frame(spark, sf_dir))
    return found.select("run_id", "error_class", _joined("data_centers"))


@query
def ssh_endpoints(spark, sf_dir):
    found = telemetry.ssh_endpoints(B.POD_SNAPSHOTS.frame(spark, sf_dir))
    return found.select("pod_id", "provider", "payload", "host", "port")


@query
def pod_readiness(spark, sf_dir):
    return telemetry.pod_readiness(B.POD_SNAPSHOTS.frame(spark, sf_dir))
