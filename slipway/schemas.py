"""Schemas of the tables the operators read."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_str, _int, _long, _dbl, _bool, _ts = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

MODEL_FILES = _struct(model_id=_str, file_name=_str, size_bytes=_long)
TENSOR_COUNTS = _struct(model_id=_str, dtype=_str, param_count=_long)
MODEL_CONFIGS = _struct(model_id=_str, config_json=_str)
MODEL_SPECS = _struct(
    model_id=_str,
    param_count=_long,
    weight_bytes=_long,
    hidden_size=_long,
    num_layers=_long,
    num_kv_heads=_long,
    head_dim=_long,
    max_context=_long,
    source=_str,
)
GPU_OFFERS = _struct(
    cloud_id=_str,
    gpu_type=_str,
    socket=_str,
    provider=_str,
    security=_str,
    data_center=_str,
    region=_str,
    country=_str,
    gpu_memory=_dbl,
    gpu_count=_int,
    stock_status=_str,
    is_spot=_bool,
    price_on_demand=_dbl,
    price_community=_dbl,
    images=T.ArrayType(_str),
    disk_min_gb=_dbl,
    disk_max_gb=_dbl,
)
RUN_REQUESTS = _struct(
    run_id=_str,
    vram_gb=_int,
    max_dollars_per_hour=_dbl,
    cloud_type=_str,
    gpu_count=_int,
)
SETTINGS_ROWS = _struct(run_id=_str, layer=_int, seq=_long, key=_str, value=_str)
CODE_FILES = _struct(project_id=_str, entry_file=_str, rel_path=_str, content=_str)
VOLUMES = _struct(volume_id=_str, name=_str, data_center_id=_str, size_gb=_int, seq=_int)
RUN_POLLS = _struct(run_id=_str, poll_ts=_ts, raw_status=_str)
RUNS = _struct(
    run_id=_str,
    pod_id=_str,
    gpu_type_id=_str,
    billing_start=_ts,
    hourly=_dbl,
    max_spend=_dbl,
    keep_pod_on_success=_bool,
)
RUN_EVENTS = _struct(run_id=_str, seq=_long, kind=_str, message=_str)
RUN_LOG_LINES = _struct(run_id=_str, stream=_str, line_no=_long, line=_str)
LAUNCH_ERRORS = _struct(run_id=_str, provider=_str, message=_str)
POD_SNAPSHOTS = _struct(pod_id=_str, provider=_str, observed_ts=_ts, payload=_str)
