"""Planning and watching GPU workloads over Spark tables and streams."""

from slipway.operators.code import (
    check_syntax,
    infer_command,
    select_bundle_files,
    select_code_files,
    verify_projects,
)
from slipway.operators.logs import (
    failure_events,
    log_entries,
    log_tail,
    parse_run_log,
    split_lines,
    stdout_tail,
)
from slipway.operators.memory import (
    estimate_for_model,
    estimate_memory,
    gpu_fit_table,
    with_scenarios,
)
from slipway.operators.offers import (
    candidate_gpus,
    clamp_disk,
    estimated_hourly,
    gpu_type_ids,
    list_offers,
    pin_gpus,
    price_offers,
    select_image,
    top_offers,
)
from slipway.operators.planning import make_plan, plan_summary, plan_volume
from slipway.operators.settings import clean_overrides, expand_templates, overlay_settings
from slipway.operators.sizing import (
    extract_architecture,
    model_size_report,
    param_rollup,
    resolve_specs,
    suggest_volume_gb,
    weight_file_rollup,
)
from slipway.operators.telemetry import (
    accrued_spend,
    classify_launch_errors,
    filter_events,
    pod_readiness,
    run_outcome,
    spend_guard,
    ssh_endpoints,
)
from slipway.session import build_session

__all__ = [
    "accrued_spend",
    "build_session",
    "candidate_gpus",
    "check_syntax",
    "clamp_disk",
    "classify_launch_errors",
    "clean_overrides",
    "estimate_for_model",
    "estimate_memory",
    "estimated_hourly",
    "expand_templates",
    "extract_architecture",
    "failure_events",
    "filter_events",
    "gpu_fit_table",
    "gpu_type_ids",
    "infer_command",
    "list_offers",
    "log_entries",
    "log_tail",
    "make_plan",
    "model_size_report",
    "overlay_settings",
    "param_rollup",
    "parse_run_log",
    "pin_gpus",
    "plan_summary",
    "plan_volume",
    "pod_readiness",
    "price_offers",
    "resolve_specs",
    "run_outcome",
    "select_bundle_files",
    "select_code_files",
    "select_image",
    "spend_guard",
    "split_lines",
    "ssh_endpoints",
    "stdout_tail",
    "suggest_volume_gb",
    "top_offers",
    "verify_projects",
    "weight_file_rollup",
    "with_scenarios",
]
