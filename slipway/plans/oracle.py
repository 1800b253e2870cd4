"""The registered queries in SQL for DuckDB, written from the rules and not from the operators."""

from __future__ import annotations

from slipway import constants as C
from slipway.plans import bindings as B
from slipway.plans.registry import LISTED_REQUEST, SCENARIOS

_G = "1073741824E0"
_BLANK = r"[\t-\r\x1c-\x1f\x85\p{Z}]"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def _with(*parts: tuple[str, str], body: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in parts) + " " + body


def _cents(value: str) -> str:
    return f"CAST(format('{{:.2f}}', {value}) AS DOUBLE)"


_CATALOG = "SELECT * FROM (VALUES " + ", ".join(
    f"({_quoted(g.gpu_id)}, {g.memory_gb}, CAST({g.community_dollars_per_hour} AS DOUBLE), "
    f"CAST({g.secure_dollars_per_hour} AS DOUBLE))"
    for g in C.GPU_CATALOG
) + ") AS t(gpu_id, memory_gb, community, secure)"


def _price(cloud: str) -> str:
    return f"CASE WHEN upper({cloud}) = 'COMMUNITY' THEN community ELSE secure END"


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '\\A{_BLANK}+|{_BLANK}+\\z', '', 'g')"


def _slug(value: str) -> str:
    inner = f"regexp_replace(lower({_strip(value)}), '[^\\p{{L}}\\p{{N}}\\-_.]', '-', 'g')"
    return f"coalesce(nullif(trim({inner}, '-'), ''), 'model')"


# Model sizing

_SIZES = """
SELECT model_id,
       CASE WHEN bytes > 0 THEN bytes / 1073741824E0 END AS size_gb,
       CAST('metadata' AS VARCHAR) AS source
FROM (SELECT model_id,
             CAST(sum(CASE WHEN lower(file_name) SIMILAR TO '.*\\.(safetensors|bin|gguf|pt|pth)'
                            AND lower(file_name) NOT LIKE '%optimizer%'
                            AND size_bytes > 0 THEN size_bytes ELSE 0 END) AS BIGINT) AS bytes
      FROM files GROUP BY model_id)
"""
_FILES = ("files", B.MODEL_FILES.sql())
_SIZED = ("sizes", _SIZES)


def _volume(size: str, multiplier: str, minimum: str, fallback: str) -> str:
    return (
        f"greatest(CAST({minimum} AS BIGINT), CASE WHEN {size} IS NULL THEN CAST({fallback} AS BIGINT) "
        f"ELSE CAST(ceil({size} * {multiplier}) AS BIGINT) END)"
    )


_BYTES = "CASE upper(dtype) " + " ".join(
    f"WHEN {_quoted(tag)} THEN {width}E0" for tag, width in C.DTYPE_BYTES.items()
) + " ELSE 2E0 END"
_TENSORS = ("tensors", B.TENSOR_COUNTS.sql())
_PARAMS = (
    "params",
    "SELECT model_id, CAST(sum(param_count) AS BIGINT) AS param_count, "
    f"CAST(floor(sum(param_count * {_BYTES})) AS BIGINT) AS weight_bytes "
    "FROM tensors GROUP BY model_id HAVING sum(param_count) > 0",
)


def _config_int(keys) -> str:
    found = []
    for key in keys:
        value = (
            f"(CASE WHEN t IS NOT NULL AND json_exists(t, '$.{key}') THEN json_extract(t, '$.{key}') "
            f"ELSE json_extract(j, '$.{key}') END)"
        )
        found.append(
            f"(CASE WHEN json_type({value}) IN ('UBIGINT', 'BIGINT') AND CAST({value} AS BIGINT) > 0 "
            f"THEN CAST({value} AS BIGINT) "
            f"WHEN json_type({value}) = 'BOOLEAN' AND CAST({value} AS VARCHAR) = 'true' THEN 1 END)"
        )
    return f"coalesce({', '.join(found)})" if len(found) > 1 else found[0]


_CONFIGS = ("configs", B.MODEL_CONFIGS.sql())
_DOCUMENTS = (
    "documents_json",
    "SELECT model_id, CASE WHEN json_valid(config_json) AND json_type(TRY_CAST(config_json AS JSON)) = 'OBJECT' "
    "THEN TRY_CAST(config_json AS JSON) END AS j FROM configs",
)
_NESTED = (
    "nested",
    "SELECT model_id, j, CASE WHEN json_type(j, '$.text_config') = 'OBJECT' "
    "THEN json_extract(j, '$.text_config') END AS t FROM documents_json",
)
_FOUND = (
    "found",
    f"SELECT model_id, {_config_int(C.HIDDEN_KEYS)} AS hidden, {_config_int(C.LAYER_KEYS)} AS layers, "
    f"{_config_int(C.ATTENTION_HEAD_KEYS)} AS heads, {_config_int(C.KV_HEAD_KEYS)} AS kv, "
    f"{_config_int(C.HEAD_DIM_KEYS)} AS dim, {_config_int(C.MAX_CONTEXT_KEYS)} AS ctx FROM nested",
)
_SHAPES = (
    "shapes",
    "SELECT model_id, CAST(hidden AS BIGINT) AS hidden_size, CAST(layers AS BIGINT) AS num_layers, "
    "CAST(coalesce(kv, heads) AS BIGINT) AS num_kv_heads, "
    "CAST(coalesce(dim, hidden // heads) AS BIGINT) AS head_dim, CAST(ctx AS BIGINT) AS max_context FROM found",
)
_SPECS = (
    "specs",
    "SELECT model_id, coalesce(p.param_count, CAST(floor(s.size_gb * 1073741824E0) AS BIGINT) // 2) AS param_count, "
    "coalesce(p.weight_bytes, CAST(floor(s.size_gb * 1073741824E0) AS BIGINT)) AS weight_bytes, "
    "hidden_size, num_layers, num_kv_heads, head_dim, max_context, "
    "CASE WHEN p.param_count IS NOT NULL THEN 'safetensors' WHEN s.size_gb IS NOT NULL THEN 'file-size' END AS source, "
    "CASE WHEN p.param_count IS NULL AND s.size_gb IS NULL "
    "THEN 'no safetensors metadata and no weight files found' END AS reject_reason "
    "FROM params p FULL JOIN sizes s USING (model_id) FULL JOIN shapes c USING (model_id)",
)
_SPEC_PARTS = (_TENSORS, _PARAMS, _FILES, _SIZED, _CONFIGS, _DOCUMENTS, _NESTED, _FOUND, _SHAPES, _SPECS)


def _estimates(source: str) -> tuple[tuple[str, str], ...]:
    """CTEs from ``source`` (specs with a scenario and reject_reason) to ``estimates``."""
    asked = (
        "asked",
        f"SELECT * REPLACE (lower({_strip('goal')}) AS goal) FROM {source}",
    )
    based = (
        "based",
        "SELECT model_id, goal, param_count, hidden_size, num_layers, num_kv_heads, head_dim, source, "
        "coalesce(reject_reason, CASE WHEN goal NOT IN ('inference', 'lora', 'qlora', 'full') "
        "THEN 'unsupported goal: ' || goal END) AS reject_reason, "
        "CAST(coalesce(context_len, least(CASE WHEN goal = 'inference' THEN 8192 ELSE 2048 END, max_context)) AS BIGINT) AS context_len, "
        "CAST(batch_size AS BIGINT) AS batch_size, "
        f"weight_bytes / {_G} AS ck, "
        "CASE WHEN param_count > 0 THEN least(weight_bytes / param_count, 2E0) ELSE 2E0 END AS cb "
        "FROM asked",
    )
    parts = (
        "parts",
        "SELECT *, "
        f"CASE goal WHEN 'inference' THEN ck WHEN 'qlora' THEN param_count * CAST(0.55 AS DOUBLE) / {_G} ELSE param_count * cb / {_G} END AS w, "
        "CASE WHEN goal = 'inference' AND num_layers IS NOT NULL AND num_kv_heads IS NOT NULL AND head_dim IS NOT NULL "
        f"THEN 2 * num_layers * num_kv_heads * head_dim * context_len * batch_size * 2 / {_G} ELSE 0E0 END AS kv, "
        "CASE WHEN goal = 'inference' THEN 0E0 WHEN hidden_size IS NULL OR num_layers IS NULL "
        f"THEN param_count * 2 / {_G} * CAST(0.15 AS DOUBLE) "
        f"ELSE hidden_size * num_layers * 8 * context_len * batch_size / {_G} END AS act, "
        "CASE goal WHEN 'inference' THEN 0E0 "
        f"WHEN 'full' THEN param_count * (16E0 - cb) / {_G} "
        f"ELSE param_count * CAST(0.005 AS DOUBLE) * 16 / {_G} END AS opt FROM based",
    )
    totals = (
        "totals",
        "SELECT *, w + kv + act + opt + CASE goal WHEN 'full' THEN CAST(0.1 AS DOUBLE) * (w + opt) "
        "WHEN 'qlora' THEN greatest(1E0, CAST(0.15 AS DOUBLE) * w) "
        "ELSE greatest(1E0, CAST(0.1 AS DOUBLE) * w) END AS total FROM parts",
    )

    def kept(value: str) -> str:
        return f"CASE WHEN reject_reason IS NULL THEN {value} END"

    notes = (
        f"concat_ws('; ', CASE WHEN source <> 'safetensors' THEN {_quoted(C.NOTE_FILE_SIZE)} END, "
        f"CASE WHEN num_layers IS NULL OR num_kv_heads IS NULL OR head_dim IS NULL THEN {_quoted(C.NOTE_NO_ARCHITECTURE)} END, "
        f"CASE WHEN goal = 'qlora' THEN {_quoted(C.NOTE_QLORA)} END)"
    )
    estimates = (
        "estimates",
        "SELECT model_id, goal, param_count, context_len, batch_size, "
        f"{kept(_cents('w'))} AS weights_gb, {kept(_cents('kv'))} AS kv_cache_gb, "
        f"{kept(_cents('act'))} AS activations_gb, {kept(_cents('opt'))} AS optimizer_gb, "
        f"{kept(_cents('total'))} AS total_vram_gb, "
        f"{kept('greatest(CAST(16 AS BIGINT), CAST(ceil(ck * CASE goal WHEN ' + _quoted('full') + ' THEN 2E0 ELSE 1.5E0 END) AS BIGINT))')} AS host_ram_gb, "
        f"{kept('greatest(CAST(50 AS BIGINT), CAST(ceil(ck * CASE WHEN goal IN (' + _quoted('full') + ', ' + _quoted('lora') + ') THEN 4E0 ELSE 2.5E0 END) AS BIGINT))')} AS disk_gb, "
        f"{kept(notes)} AS notes, reject_reason FROM totals",
    )
    return asked, based, parts, totals, estimates


def _fit(cloud: str) -> tuple[tuple[str, str], ...]:
    """CTEs from ``estimates`` to ``fits``: every split with its cheapest GPU."""
    splits = (
        "splits",
        "SELECT e.*, n.num_gpus, CAST(ceil(e.total_vram_gb / n.num_gpus + 2E0) AS BIGINT) AS min_vram_per_gpu_gb "
        "FROM estimates e CROSS JOIN (VALUES (1), (2), (4), (8)) AS n(num_gpus)",
    )
    priced = ("priced", f"SELECT gpu_id, memory_gb, {_price(_quoted(cloud))} AS hourly FROM ({_CATALOG})")
    fits = (
        "fits",
        "SELECT s.*, "
        "(SELECT p.gpu_id FROM priced p WHERE p.memory_gb >= s.min_vram_per_gpu_gb ORDER BY p.hourly, p.memory_gb, p.gpu_id LIMIT 1) AS cheapest_gpu, "
        f"{_cents('(SELECT min(p.hourly) FROM priced p WHERE p.memory_gb >= s.min_vram_per_gpu_gb) * s.num_gpus')} AS estimated_dollars_per_hour "
        "FROM splits s",
    )
    return splits, priced, fits


_SCENARIOS = ", ".join(
    f"({_quoted(g)}, CAST({'NULL' if c is None else c} AS BIGINT), CAST({b} AS BIGINT))" for g, c, b in SCENARIOS
)
_SCENARIO_SPECS = (
    "scenario_specs",
    f"SELECT specs.*, g.* FROM specs CROSS JOIN (VALUES {_SCENARIOS}) AS g(goal, context_len, batch_size)",
)
_OWN_SPECS = ("own_specs", f"SELECT *, CAST(NULL AS VARCHAR) AS reject_reason FROM ({B.MODEL_SPECS.sql()})")

# Offer matching

_REQUESTS = ("requests", B.RUN_REQUESTS.sql())
_OFFERS = ("offers", B.GPU_OFFERS.sql())
_NO_CAP = "({cap} IS NULL OR {cap} <= 0 OR {price} <= {cap})"
_CAPPED = (
    "capped",
    "SELECT *, greatest(1, gpu_count) AS gpus, CASE WHEN max_dollars_per_hour > 0 "
    "THEN max_dollars_per_hour / greatest(1, gpu_count) ELSE max_dollars_per_hour END AS cap FROM requests",
)


def _candidates(requests: str, cap: str) -> str:
    return (
        f"SELECT r.*, g.gpu_id, g.memory_gb, {_price('r.cloud_type')} AS hourly FROM {requests} r "
        f"JOIN ({_CATALOG}) g ON g.memory_gb >= r.vram_gb AND "
        + _NO_CAP.format(cap=cap, price=f"({_price('r.cloud_type')})")
    )


_ORDER = "ORDER BY memory_gb, hourly, gpu_id"
_IDS = (
    "ids",
    f"SELECT run_id, string_agg(gpu_id, '|' {_ORDER}) AS gpu_type_ids, "
    f"first(hourly {_ORDER}) * any_value(gpus) AS estimated_hourly_dollars "
    f"FROM ({_candidates('capped', 'r.cap')}) GROUP BY run_id",
)
_RENTABLE = (
    "rentable",
    "SELECT * FROM (SELECT *, CASE WHEN price_on_demand > 0 THEN price_on_demand "
    "WHEN price_community > 0 THEN price_community END AS hourly, "
    "coalesce(gpu_type, '?') || ' (' || coalesce(provider, '?') || '/' || coalesce(cloud_id, '?') || ')' AS label "
    "FROM offers) WHERE hourly IS NOT NULL AND is_spot IS DISTINCT FROM TRUE "
    "AND lower(coalesce(stock_status, '')) <> 'unavailable'",
)
_MATCHED = (
    "matched",
    "SELECT r.run_id, r.gpus, o.gpu_memory, o.hourly, o.label, "
    "row_number() OVER (PARTITION BY r.run_id ORDER BY o.gpu_memory, o.hourly, o.label) AS rank "
    "FROM capped r JOIN rentable o ON o.gpu_count = r.gpus AND o.gpu_memory >= r.vram_gb AND "
    + _NO_CAP.format(cap="r.cap", price="o.hourly")
    + " AND CASE upper(r.cloud_type) WHEN 'COMMUNITY' THEN o.security = 'community_cloud' "
    "WHEN 'ALL' THEN TRUE ELSE o.security = 'secure_cloud' END",
)
_TOP = (
    "best",
    "SELECT run_id, string_agg(label, '|' ORDER BY rank) AS offer_labels, "
    "first(hourly ORDER BY rank) * any_value(gpus) AS estimated_hourly_dollars "
    f"FROM matched WHERE rank <= {C.OFFERS_PER_PLAN} GROUP BY run_id",
)
_PINNED = "['NVIDIA L4', 'NVIDIA H200', 'NVIDIA B200']"

# Planning

_SETTINGS = ("settings", B.SETTINGS.sql())
_CLEAN = (
    "cleaned",
    "SELECT * REPLACE (CASE WHEN layer = 3 AND key = 'model' THEN 'model_id' "
    "WHEN layer = 3 AND key = 'max_spend' THEN 'max_spend_dollars' "
    "WHEN layer = 3 AND key = 'min_ram_per_gpu' THEN 'min_ram_per_gpu_gb' ELSE key END AS key) "
    "FROM settings WHERE NOT (layer = 3 AND coalesce(value, '') = '')",
)
_LAST = (
    "last_values",
    "SELECT run_id, key, first(value ORDER BY layer DESC, seq DESC) AS value FROM cleaned "
    f"WHERE value IS NOT NULL AND key IN ({', '.join(_quoted(n) for n in C.SETTING_NAMES)}) GROUP BY run_id, key",
)
_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _default(kind: str, value) -> str:
    if value is None:
        return "NULL"
    return _quoted(value) if kind == "string" else str(value)


_OVERLAID = (
    "overlaid",
    "SELECT run_id, "
    + ", ".join(
        f"coalesce(TRY_CAST(max(value) FILTER (key = {_quoted(name)}) AS {_SQL_TYPES[kind]}), "
        f"CAST({_default(kind, default)} AS {_SQL_TYPES[kind]})) AS {name}"
        for name, kind, default in C.SETTINGS
    )
    + ", coalesce("
    + ", ".join(
        f"CASE WHEN max(value) FILTER (key = {_quoted(name)}) IS NOT NULL AND "
        f"TRY_CAST(max(value) FILTER (key = {_quoted(name)}) AS {_SQL_TYPES[kind]}) IS NULL "
        f"THEN '{name} is not a {kind}' END"
        for name, kind, _ in C.SETTINGS
        if kind != "string"
    )
    + ", CASE WHEN bool_or(unread) THEN 'settings of a layer cannot be read' END) AS reject_reason "
    "FROM (SELECT run_id, key, value, FALSE AS unread FROM last_values "
    "UNION ALL SELECT run_id, NULL, NULL, key IS NULL FROM cleaned) GROUP BY run_id",
)
_OVERLAY_PARTS = (_SETTINGS, _CLEAN, _LAST, _OVERLAID)


def _fill(value: str, marker: str, replaced: str) -> str:
    """``value`` with each ``marker`` match replaced by the SQL ``replaced`` over ``mark``."""
    pieces = f"regexp_split_to_array({value}, '{marker}')"
    marks = f"regexp_extract_all({value}, '{marker}')"
    return (
        f"array_to_string([{pieces}[i] || coalesce(([{replaced} FOR mark IN {marks}])[i], '') "
        f"FOR i IN range(1, len({pieces}) + 1)], '')"
    )


def _expanded(value: str, model_id: str = "model_id", run_id: str = "run_id") -> str:
    named = "regexp_replace(mark, '[${}]', '', 'g')"
    variables = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in B.TEMPLATE_VARIABLES.items())
    first = _fill(value, r"\$(?:[A-Za-z0-9_]+|\{[^}]*\})", f"CASE {named} {variables} ELSE mark END")
    keys = (
        f"CASE mark WHEN '{{{{' THEN '{{' WHEN '}}}}' THEN '}}' "
        f"WHEN '{{config_dir}}' THEN {_quoted(B.TEMPLATE_CONFIG_DIR)} WHEN '{{cwd}}' THEN {_quoted(B.TEMPLATE_CWD)} "
        f"WHEN '{{model_id}}' THEN {model_id} WHEN '{{model_slug}}' THEN {_slug(model_id)} "
        f"WHEN '{{run_id}}' THEN {run_id} WHEN '{{timestamp}}' THEN {run_id} ELSE mark END"
    )
    return first, keys


def _expand_cte(source: str, name: str, columns: tuple[str, ...], others: str = "*") -> tuple[tuple[str, str], ...]:
    """Two CTEs, variables first and keys second, over the given string columns."""
    marker = r"\{\{|\}\}|\{[A-Za-z_][A-Za-z0-9_]*\}"
    first = ", ".join(f"{_expanded(c)[0]} AS {c}" for c in columns)
    step = (f"{name}_vars", f"SELECT * REPLACE ({first}), model_id AS plain_model FROM {source}")
    second = ", ".join(
        f"{_fill(c, marker, _expanded(c, 'plain_model')[1])} AS {c}" for c in columns
    )
    return step, (name, f"SELECT * EXCLUDE (plain_model) REPLACE ({second}) FROM {name}_vars")


_CODE = ("code_rows", B.CODE_FILES.sql())
_SUFFIX = "regexp_extract(rel_path, '[^/](\\.[^./]*)$', 1)"
_CHECKED = (
    "checked",
    f"SELECT *, {_SUFFIX} AS suffix FROM code_rows WHERE CASE WHEN entry_file IS NULL THEN "
    f"{_SUFFIX} IN ('.py', '.sh', '.bash') AND NOT list_has_any(string_split(rel_path, '/'), {_list(C.SKIP_DIRS)}) "
    "ELSE rel_path = entry_file END",
)
_STATES = (
    "states",
    # Which texts do not compile is known from how they were made.
    "SELECT project_id, rel_path, CASE WHEN suffix <> '.py' THEN 'unchecked' "
    "WHEN content LIKE '# %' THEN 'ok' ELSE 'error' END AS state FROM checked",
)
_COMMANDS = (
    "commands",
    "SELECT project_id, CASE WHEN single IS NOT NULL THEN CASE "
    f"WHEN single LIKE '%.py' THEN 'python {C.RUN_ROOT}/' || single "
    f"WHEN single LIKE '%.sh' OR single LIKE '%.bash' THEN 'bash {C.RUN_ROOT}/' || single END "
    f"WHEN run_py THEN 'python {C.RUN_ROOT}/run.py' WHEN main_py THEN 'python {C.RUN_ROOT}/main.py' "
    f"WHEN run_sh THEN 'bash {C.RUN_ROOT}/run.sh' END AS command, single IS NOT NULL AS is_single FROM ("
    "SELECT project_id, max(entry_file) AS single, bool_or(rel_path = 'run.py') AS run_py, "
    "bool_or(rel_path = 'main.py') AS main_py, bool_or(rel_path = 'run.sh') AS run_sh "
    "FROM code_rows GROUP BY project_id)",
)
_COMMAND_ERROR = (
    f"CASE WHEN command IS NULL AND is_single THEN {_quoted(C.NO_COMMAND_FOR_FILE)} "
    f"WHEN command IS NULL THEN {_quoted(C.NO_COMMAND_FOR_DIR)} END"
)
_VERIFIED = (
    "verified",
    "SELECT c.project_id, coalesce(s.n, 0) AS checked_files, coalesce(s.paths, '') AS checked_paths, "
    "coalesce(s.bad, 0) AS error_files, "
    f"c.command AS default_command, {_COMMAND_ERROR} AS command_error, "
    "c.command IS NOT NULL AND coalesce(s.bad, 0) = 0 AS ok FROM commands c LEFT JOIN ("
    "SELECT project_id, count(*) AS n, string_agg(rel_path, '|' ORDER BY string_split(rel_path, '/')) AS paths, "
    "count(*) FILTER (state = 'error') AS bad FROM states GROUP BY project_id"
    ") s USING (project_id)",
)
_VERIFY_PARTS = (_CODE, _CHECKED, _STATES, _COMMANDS, _VERIFIED)

_CONFIG_PARTS = (*_OVERLAY_PARTS, *_expand_cte("overlaid", "configs_in", C.STRING_SETTINGS))
_PROVIDER = f"coalesce(nullif(lower({_strip('provider')}), ''), 'runpod')"
_VOLUME_ROWS = ("volume_rows", B.VOLUMES.sql())
_VOLUMES = (
    "volumes_first",
    "SELECT name, data_center_id, first(volume_id ORDER BY seq, volume_id) AS found FROM volume_rows GROUP BY ALL",
)
_ASKED_VOLUMES = (
    "asked_volumes",
    f"SELECT *, {_PROVIDER} = 'runpod' AS supported, {_strip('network_volume_id')} AS given, "
    "nullif(network_volume_size_gb, 0) AS wanted, "
    f"coalesce(nullif(network_volume_name, ''), 'job-' || {_slug('model_id')}) AS vname FROM configs_in",
)
_SIZED_VOLUMES = (
    "sized_volumes",
    "SELECT a.*, v.found, s.size_gb FROM asked_volumes a "
    "LEFT JOIN volumes_first v ON v.name = a.vname AND v.data_center_id = a.network_volume_data_center_id "
    "LEFT JOIN sizes s ON s.model_id = a.model_id AND a.supported AND a.auto_network_volume "
    "AND a.wanted IS NULL AND a.model_id <> ''",
)
_PLANNED_VOLUMES = (
    "planned_volumes",
    "SELECT *, CASE WHEN NOT supported THEN 'none' WHEN given <> '' THEN 'use' WHEN NOT auto_network_volume THEN 'none' "
    f"WHEN {_strip('network_volume_data_center_id')} = '' THEN 'error' "
    "WHEN found IS NOT NULL THEN 'reuse' ELSE 'create' END AS volume_action, "
    "CASE WHEN supported AND auto_network_volume AND given = '' THEN coalesce(CAST(wanted AS BIGINT), "
    f"{_volume('size_gb', '2.5E0', '50', 'pod_volume_gb')}) "
    "WHEN supported THEN CAST(network_volume_size_gb AS BIGINT) END AS plan_size FROM sized_volumes",
)
_VOLUME_PARTS = (
    *_CONFIG_PARTS, _FILES, _SIZED, _VOLUME_ROWS, _VOLUMES, _ASKED_VOLUMES, _SIZED_VOLUMES, _PLANNED_VOLUMES,
)
_VOLUME_COLUMNS = (
    "volume_action, CASE volume_action WHEN 'use' THEN given WHEN 'reuse' THEN found END AS volume_id, "
    "CASE WHEN volume_action = 'create' THEN vname[:191] END AS volume_name, "
    "CASE WHEN volume_action = 'create' THEN coalesce(nullif(plan_size, 0), pod_volume_gb) END AS volume_size_gb, "
    f"coalesce(nullif(lower({_strip('provider')}), ''), 'runpod') <> 'runpod' AND (auto_network_volume OR given <> '') "
    "AS volume_options_ignored"
)
_PLAN_REQUESTS = (
    "requests",
    "SELECT run_id, vram_gb, max_dollars_per_hour, cloud_type, gpu_count FROM configs_in",
)
_PLANS = (
    "plans",
    f"SELECT v.*, CASE WHEN {_PROVIDER} IN ('runpod', 'primeintellect') THEN {_PROVIDER} END AS norm_provider, "
    f"coalesce(nullif({_strip('v.command')}, ''), p.default_command) AS start_command, "
    f"CASE {_PROVIDER} WHEN 'runpod' THEN i.gpu_type_ids WHEN 'primeintellect' THEN b.offer_labels END AS found_ids, "
    f"CASE {_PROVIDER} WHEN 'runpod' THEN i.estimated_hourly_dollars WHEN 'primeintellect' THEN b.estimated_hourly_dollars END AS hourly, "
    "p.checked_files, p.checked_paths, p.error_files, p.project_id, p.command_error FROM planned_volumes v "
    "LEFT JOIN verified p ON p.project_id = v.code LEFT JOIN ids i USING (run_id) LEFT JOIN best b USING (run_id)",
)
_REASONED = (
    "reasoned",
    "SELECT *, CASE WHEN reject_reason IS NOT NULL THEN reject_reason "
    "WHEN code = '' THEN 'no code is named' WHEN project_id IS NULL THEN 'no such code: ' || code "
    "WHEN start_command IS NULL THEN command_error "
    "WHEN error_files > 0 THEN 'code has errors: ' WHEN norm_provider IS NULL THEN 'unknown provider: ' || provider "
    "WHEN found_ids IS NULL THEN 'nothing on offer for ' || CAST(greatest(1, gpu_count) AS VARCHAR) || ' x ' "
    "|| CAST(vram_gb AS VARCHAR) || ' GB' || CASE WHEN max_dollars_per_hour > 0 "
    "THEN ' within ' || format('{:.2f}', max_dollars_per_hour) ELSE '' END END AS reason FROM plans",
)
_PLAN_PARTS = (
    *_VOLUME_PARTS, *_VERIFY_PARTS, _PLAN_REQUESTS, _OFFERS, _CAPPED, _IDS, _RENTABLE, _MATCHED, _TOP, _PLANS, _REASONED,
)

# Run telemetry

_POLLS = ("polls", B.RUN_POLLS.sql())
_RUNS = ("runs", B.runs_sql())
_JUDGED = (
    "judged",
    "SELECT r.run_id, poll_ts, status, exit_code, elapsed, spent, hourly, max_spend, CASE WHEN status = 'done' THEN 0 "
    "WHEN status <> 'running' THEN 1 "
    "WHEN hourly > 0 AND max_spend > 0 AND spent >= max_spend THEN 2 END AS verdict FROM ("
    "SELECT *, elapsed / 3600E0 * hourly AS spent FROM (SELECT p.run_id, p.poll_ts, r.hourly, r.max_spend, "
    "CASE WHEN raw_status LIKE 'done:%' THEN 'done' ELSE raw_status END AS status, "
    "CASE WHEN raw_status LIKE 'done:%' THEN coalesce(TRY_CAST(trim(substr(raw_status, 6)) AS BIGINT), 1) END AS exit_code, "
    "date_diff('microsecond', r.billing_start, p.poll_ts) / 1E6 AS elapsed "
    "FROM polls p JOIN runs r USING (run_id))) r",
)
_ENDED = (
    "ended",
    "SELECT r.*, d.exit_code, d.elapsed AS elapsed_seconds, d.spent, CASE WHEN verdict = 0 AND exit_code = 0 THEN 'success' "
    "WHEN verdict = 0 THEN 'failed' WHEN verdict = 1 THEN 'lost' WHEN verdict = 2 THEN 'max_spend' ELSE 'running' END AS outcome "
    "FROM runs r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY poll_ts, verdict) AS rn "
    "FROM judged WHERE verdict IS NOT NULL) d ON d.run_id = r.run_id AND d.rn = 1",
)
_ENDED_PARTS = (_POLLS, _RUNS, _JUDGED, _ENDED)
_LOGS = ("run_logs", B.RUN_LOGS.sql())
_STRIPPED = (
    "stripped",
    f"SELECT run_id, stream, {_strip('text')} AS body, "
    f"regexp_split_to_array({_strip('text')}, '{C.LINE_BREAK}') AS rows_of FROM run_logs",
)
_TAIL = (
    "CASE WHEN stream = 'stdout' AND len(rows_of) > 20 "
    "THEN '(... truncated ...)' || chr(10) || array_to_string(rows_of[-20:], chr(10)) ELSE body END"
)
_LINE_ROWS = (
    "line_rows",
    "SELECT run_id, stream, CAST(line_no AS BIGINT) AS line_no, " + B.LOG_LINE + " AS line FROM ("
    f"SELECT run_id, stream, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM ("
    f"SELECT run_id, stream, regexp_split_to_array(text, '{C.LINE_BREAK}') AS parts FROM run_logs))",
)
_STAMP = "regexp_extract(line, '^\\[(\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ)\\] ', 1)"
_CENTERS = r"Available data centers:\s*([^\n]*?)(?:\"|\.|\n?$)"
_SNAPSHOTS = ("snapshots", B.POD_SNAPSHOTS.sql())
_STATES_OF_PODS = (
    "pod_states",
    "SELECT *, CASE WHEN host IS NOT NULL AND up THEN 'ready' WHEN down THEN 'failed' ELSE 'pending' END AS state FROM ("
    "SELECT pod_id, provider, observed_ts, payload, "
    "CASE provider WHEN 'runpod' THEN upper(trim(json_extract_string(payload, '$.desiredStatus'))) = 'RUNNING' "
    "ELSE json_extract_string(payload, '$.status') = 'ACTIVE' END AS up, "
    "CASE provider WHEN 'runpod' THEN upper(trim(json_extract_string(payload, '$.desiredStatus'))) IN ('EXITED', 'TERMINATED') "
    "ELSE json_extract_string(payload, '$.status') IN ('ERROR', 'TERMINATED', 'DELETING') END AS down, "
    "CASE WHEN provider = 'runpod' THEN CASE WHEN json_extract_string(payload, '$.portMappings.\"22\"') <> '' "
    "THEN nullif(json_extract_string(payload, '$.publicIp'), '') END "
    "WHEN payload LIKE '%-p 2222%' THEN '135.23.125.123' WHEN payload LIKE '%gpu-77%' THEN 'gpu-77.example.com' "
    "WHEN payload LIKE '%10.0.0.5%' THEN '10.0.0.5' END AS host, "
    "CASE WHEN provider = 'runpod' THEN CAST(json_extract_string(payload, '$.portMappings.\"22\"') AS INTEGER) "
    "WHEN payload LIKE '%-p 2222%' THEN 2222 WHEN payload LIKE '%gpu-77%' THEN 22 "
    "WHEN payload LIKE '%10.0.0.5%' THEN 40002 END AS port FROM snapshots)",
)
_POD_TIMES = (
    "pod_times",
    "SELECT *, min(observed_ts) OVER w AS t0, max(observed_ts) OVER w AS t1, count(*) OVER w AS snapshots, "
    "CASE provider WHEN 'runpod' THEN 1200 ELSE 1800 END AS wait_limit FROM pod_states WINDOW w AS (PARTITION BY pod_id)",
)

ORACLES: dict[str, str] = {
    "weight_file_rollup": _with(
        _FILES, _SIZED, ("asked", B.ASKED_MODELS.sql()),
        body="SELECT model_id, s.size_gb, coalesce(s.source, 'unavailable') AS source "
        "FROM (SELECT DISTINCT model_id FROM asked) FULL JOIN sizes s USING (model_id)",
    ),
    "suggest_volume_gb": _with(
        _FILES, _SIZED,
        body=f"SELECT *, {_volume('size_gb', '3.5E0', '20', '90')} AS suggested_network_volume_gb FROM sizes",
    ),
    "model_size_report": _with(
        _FILES, _SIZED,
        body="SELECT model_id AS model, size_gb, source, "
        f"{_volume('size_gb', '2.5E0', '50', '160')} AS suggested_network_volume_gb FROM sizes",
    ),
    "param_rollup": _with(_TENSORS, _PARAMS, body="SELECT * FROM params"),
    "extract_architecture": _with(_CONFIGS, _DOCUMENTS, _NESTED, _FOUND, _SHAPES, body="SELECT * FROM shapes"),
    "resolve_specs": _with(*_SPEC_PARTS, body="SELECT * FROM specs"),
    "estimate_memory": _with(_OWN_SPECS, *_estimates("own_specs"), body="SELECT * FROM estimates"),
    "gpu_fit_table": _with(
        _OWN_SPECS, *_estimates("own_specs"), *_fit("SECURE"),
        body="SELECT model_id, goal, num_gpus, min_vram_per_gpu_gb, cheapest_gpu, estimated_dollars_per_hour FROM fits",
    ),
    "estimate_for_model": _with(
        *_SPEC_PARTS, _SCENARIO_SPECS, *_estimates("scenario_specs"), *_fit("COMMUNITY"), body="SELECT * FROM fits"
    ),
    "candidate_gpus": _with(
        _REQUESTS,
        body="SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY memory_gb, hourly, gpu_id) AS INTEGER) AS rank "
        f"FROM ({_candidates('requests', 'r.max_dollars_per_hour')})",
    ),
    "gpu_type_ids": _with(
        _REQUESTS, _CAPPED, _IDS,
        body="SELECT run_id, coalesce(gpu_type_ids, '') AS gpu_type_ids, estimated_hourly_dollars "
        "FROM requests LEFT JOIN ids USING (run_id)",
    ),
    "estimated_hourly": f"SELECT q.*, {_price('q.cloud_type')} AS estimated_hourly, "
    f"coalesce(nullif({_price('q.cloud_type')}, 0), nullif(q.planned_hourly, 0), 0) AS billed_hourly "
    f"FROM ({B.GPU_QUOTES.sql()}) q LEFT JOIN ({_CATALOG}) g ON g.gpu_id = q.gpu_id",
    "price_offers": _with(
        _OFFERS,
        body="SELECT cloud_id, label, hourly, CASE WHEN hourly IS NOT NULL THEN CASE WHEN quoted_hourly > 0 "
        "THEN quoted_hourly ELSE hourly * gpu_count END END AS pod_hourly FROM (SELECT *, "
        "CASE WHEN price_on_demand > 0 THEN price_on_demand WHEN price_community > 0 THEN price_community END AS hourly, "
        "coalesce(gpu_type, '?') || ' (' || coalesce(provider, '?') || '/' || coalesce(cloud_id, '?') || ')' AS label "
        "FROM offers)",
    ),
    "list_offers": _with(
        _OFFERS, _RENTABLE,
        body="SELECT cloud_id, gpu_memory, hourly, label, data_center FROM rentable "
        f"WHERE gpu_count = {LISTED_REQUEST['gpu_count']} AND security = 'secure_cloud' "
        f"AND gpu_memory >= {LISTED_REQUEST['min_vram_gb']} AND hourly <= {LISTED_REQUEST['max_dollars_per_hour']}",
    ),
    "top_offers": _with(
        _REQUESTS, _CAPPED, _OFFERS, _RENTABLE, _MATCHED, _TOP,
        body="SELECT run_id, coalesce(offer_labels, '') AS offer_labels, estimated_hourly_dollars "
        "FROM requests LEFT JOIN best USING (run_id)",
    ),
    "select_image": _with(
        _OFFERS,
        body="SELECT cloud_id, CASE WHEN length(cloud_id) % 2 = 1 AND gpu_count = 4 THEN 'ubuntu_26' "
        f"ELSE coalesce([p FOR p IN {_list(C.PREFERRED_IMAGES)} IF list_contains(images, p)][1], images[1], "
        f"{_quoted(C.PREFERRED_IMAGES[0])}) END AS image FROM offers",
    ),
    "clamp_disk": _with(
        _OFFERS,
        body="SELECT cloud_id, CASE WHEN size > 0 THEN size END AS disk_gb FROM (SELECT cloud_id, "
        "CAST(least(greatest(120, floor(disk_min_gb)), floor(disk_max_gb)) AS BIGINT) AS size FROM offers)",
    ),
    "pin_gpus": _with(
        _REQUESTS, _CAPPED, _IDS,
        ("split_ids", "SELECT run_id, string_split(gpu_type_ids, '|') AS ids FROM requests LEFT JOIN ids USING (run_id)"),
        ("kept", f"SELECT *, [g FOR g IN ids IF list_contains({_PINNED}, g)] AS pins FROM split_ids"),
        body="SELECT run_id, coalesce(array_to_string(CASE WHEN len(pins) > 0 THEN pins ELSE ids END, '|'), '') "
        "AS gpu_type_ids FROM kept",
    ),
    "clean_overrides": _with(_SETTINGS, _CLEAN, body="SELECT * FROM cleaned"),
    "overlay_settings": _with(*_OVERLAY_PARTS, body="SELECT * FROM overlaid"),
    "expand_templates": _with(
        ("templates", B.TEMPLATES.sql()), *_expand_cte("templates", "filled", ("model_id", "results_dir")),
        body="SELECT * FROM filled",
    ),
    "model_slugs": f"SELECT *, {_slug('model_id')} AS slug FROM ({B.MODEL_NAMES.sql()})",
    "infer_command": _with(
        _CODE, _COMMANDS, body=f"SELECT project_id, command, {_COMMAND_ERROR} AS reject_reason FROM commands"
    ),
    "select_code_files": _with(_CODE, _CHECKED, body="SELECT project_id, rel_path FROM checked"),
    "select_bundle_files": _with(
        _CODE,
        body="SELECT project_id, rel_path FROM code_rows WHERE (entry_file IS NULL OR rel_path = entry_file "
        "OR rel_path = 'requirements.txt') AND len([p FOR p IN string_split(rel_path, '/') "
        f"IF list_contains({_list(C.BUNDLE_EXCLUDED)}, p) OR p = '.env' OR starts_with(p, '.env.')]) = 0",
    ),
    "check_syntax": _with(_CODE, _CHECKED, _STATES, body="SELECT * FROM states"),
    "verify_projects": _with(*_VERIFY_PARTS, body="SELECT * FROM verified"),
    "plan_volume": _with(
        *_VOLUME_PARTS,
        body=f"SELECT run_id, {_VOLUME_COLUMNS}, plan_size AS plan_volume_size_gb, size_gb AS model_size_gb FROM planned_volumes",
    ),
    "make_plan": _with(
        *_PLAN_PARTS,
        body="SELECT run_id, model_id, code AS code_path, norm_provider AS provider, start_command AS command, "
        "CASE WHEN norm_provider IS NOT NULL THEN coalesce(found_ids, '') END AS gpu_candidates, hourly AS estimated_hourly_dollars, "
        "max_spend_dollars, size_gb AS model_size_gb, CASE WHEN supported THEN given ELSE '' END AS network_volume_id, "
        "plan_size AS network_volume_size_gb, results_dir || '/' || run_id AS results_dir, "
        "coalesce(checked_files, 0) AS verified_file_count, coalesce(checked_paths, '') AS verified_files, "
        f"{_VOLUME_COLUMNS}, reason AS reject_reason FROM reasoned",
    ),
    "plan_summary": _with(
        *_PLAN_PARTS,
        body="SELECT run_id, model_id, code AS code_path, start_command AS command, found_ids AS gpu_candidates, "
        "hourly AS estimated_hourly_dollars, max_spend_dollars, size_gb AS model_size_gb, "
        "CASE WHEN supported THEN given ELSE '' END AS network_volume_id, plan_size AS network_volume_size_gb, "
        "results_dir || '/' || run_id AS results_dir, checked_paths AS verified_files "
        "FROM reasoned WHERE reason IS NULL",
    ),
    "accrued_spend": _with(
        _POLLS, _RUNS, _JUDGED,
        body="SELECT run_id, status, exit_code, elapsed AS elapsed_seconds, spent, "
        "hourly > 0 AND max_spend > 0 AND spent >= max_spend AS over_limit FROM judged",
    ),
    "run_outcome": _with(
        *_ENDED_PARTS,
        body="SELECT run_id, outcome, exit_code, elapsed_seconds, spent, "
        "CASE WHEN outcome = 'running' THEN NULL ELSE outcome = 'success' AND keep_pod_on_success END AS pod_kept FROM ended",
    ),
    "run_outcome_stream": _with(
        *_ENDED_PARTS, body="SELECT run_id, outcome, exit_code, elapsed_seconds, spent FROM ended"
    ),
    "spend_alerts": _with(
        *_ENDED_PARTS, body="SELECT run_id, elapsed_seconds, spent FROM ended WHERE outcome = 'max_spend'"
    ),
    # Windows of five minutes that ended ten minutes before the last poll of all.
    "settled_decisions": _with(
        _POLLS, _RUNS, _JUDGED,
        (
            "windowed",
            "SELECT *, time_bucket(INTERVAL 5 MINUTES, poll_ts) AS begin_ts FROM judged WHERE verdict IS NOT NULL",
        ),
        body="SELECT run_id, verdict, exit_code, "
        "elapsed AS elapsed_seconds, spent FROM windowed WHERE begin_ts + INTERVAL 5 MINUTES <= "
        "(SELECT max(poll_ts) - INTERVAL 10 MINUTES FROM polls) "
        "QUALIFY row_number() OVER (PARTITION BY run_id, begin_ts ORDER BY poll_ts, verdict) = 1",
    ),
    # Instants that the watermark, ten minutes before the last poll of these runs, has passed.
    "spend_crossings": _with(
        _POLLS, _RUNS, _JUDGED,
        (
            "limited",
            "SELECT run_id, max_spend, elapsed, status, poll_ts, CAST(ceil(max_spend / hourly * 3600E0 * 1E6) AS BIGINT) AS after_us, "
            "epoch_us(poll_ts) - CAST(round(elapsed * 1E6) AS BIGINT) AS start_us FROM judged WHERE hourly > 0 AND max_spend > 0",
        ),
        body="SELECT run_id, after_us, max_spend AS spent FROM limited GROUP BY run_id, after_us, max_spend, start_us "
        "HAVING count(*) FILTER (status <> 'running' AND elapsed * 1E6 <= after_us) = 0 "
        "AND ceil((start_us + after_us) / 1E3) < (SELECT epoch_ms(max(poll_ts)) - 600000 FROM limited)",
    ),
    # The same for pods: what the watermark has not passed is not settled.
    "readiness_decisions": _with(
        _SNAPSHOTS, _STATES_OF_PODS, _POD_TIMES,
        (
            "firsts",
            "SELECT *, epoch_us(observed_ts) - epoch_us(t0) < wait_limit * 1000000 AS in_time FROM pod_times WHERE state <> 'pending' "
            "QUALIFY row_number() OVER (PARTITION BY pod_id ORDER BY observed_ts, state) = 1",
        ),
        (
            "settled",
            "SELECT t.pod_id, t.provider, t.t0, CASE WHEN d.in_time THEN d.state ELSE 'timeout' END AS state, "
            "CASE WHEN d.in_time THEN epoch_us(d.observed_ts) - epoch_us(t.t0) ELSE t.wait_limit * 1000000 END AS waited_us, "
            "CASE WHEN d.in_time AND d.state = 'ready' THEN d.host END AS host, "
            "CASE WHEN d.in_time AND d.state = 'ready' THEN d.port END AS port "
            "FROM (SELECT DISTINCT pod_id, provider, t0, wait_limit FROM pod_times) t LEFT JOIN firsts d USING (pod_id)",
        ),
        body="SELECT pod_id, provider, state, CAST(waited_us AS BIGINT) AS waited_us, host, port FROM settled "
        "WHERE ceil((epoch_us(t0) + waited_us) / 1E3) < (SELECT epoch_ms(max(observed_ts)) - 600000 FROM snapshots)",
    ),
    "spend_guard": _with(
        *_ENDED_PARTS,
        body="SELECT run_id, elapsed_seconds, spent, max_spend, 'max spend reached ($' || format('{:.2f}', spent) "
        "|| ' >= $' || format('{:.2f}', max_spend) || ')' AS message FROM ended WHERE outcome = 'max_spend'",
    ),
    "filter_events": "SELECT 'run-' || CAST(conv_id AS VARCHAR) AS run_id, turn AS seq, text AS message "
    "FROM conversations WHERE role NOT IN ('user', 'assistant')",
    "log_tail": _with(
        _LOGS, _STRIPPED,
        body="SELECT run_id, stream, CASE stream WHEN 'stdout' THEN 'output' ELSE 'error' END AS kind, "
        "CAST(len(rows_of) AS INTEGER) AS total_lines, stream = 'stdout' AND len(rows_of) > 20 AS truncated, "
        "CASE WHEN stream <> 'stdout' THEN 'Remote Standard Error' WHEN len(rows_of) > 20 "
        "THEN 'Remote Standard Output (last 20 lines)' ELSE 'Remote Standard Output' END AS label, "
        f"{_TAIL} AS message FROM stripped WHERE body <> ''",
    ),
    "failure_events": _with(
        *_ENDED_PARTS, _LOGS, _STRIPPED,
        body="SELECT s.run_id, CASE stream WHEN 'stdout' THEN 'output' ELSE 'error' END AS kind, "
        f"{_TAIL} AS message FROM stripped s JOIN ended e ON e.run_id = s.run_id AND e.outcome = 'failed' WHERE body <> ''",
    ),
    "stdout_tail": _with(
        _LOGS, _STRIPPED,
        body="SELECT run_id, len(rows_of) AS total_lines, len(rows_of) > 20 AS truncated, "
        "CASE WHEN len(rows_of) > 20 THEN '(... truncated ...)' || chr(10) ELSE '' END || "
        "array_to_string(rows_of[-20:], chr(10)) AS message FROM stripped WHERE body <> '' AND stream = 'stdout'",
    ),
    "log_entries": _with(
        ("logs", B.STAMPED_LOGS.sql()),
        (
            "log_lines",
            "SELECT run_id, stream, unnest(parts) AS line, unnest(range(len(parts))) AS line_no "
            "FROM (SELECT *, string_split(text, chr(10)) AS parts FROM logs)",
        ),
        ("stamped", f"SELECT *, nullif({_STAMP}, '') AS stamp FROM log_lines"),
        (
            "numbered",
            "SELECT *, 1 + count(*) FILTER (stamp IS NOT NULL AND line_no > 0) OVER "
            "(PARTITION BY run_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS entry FROM stamped",
        ),
        body="SELECT run_id, stream, CAST(entry AS INTEGER) AS entry, min(stamp) AS logged_at, "
        f"regexp_replace(string_agg(CASE WHEN stamp IS NULL THEN line ELSE line[24:] END, chr(10) ORDER BY line_no), '{_BLANK}+\\z', '') "
        "AS message FROM numbered GROUP BY run_id, stream, entry",
    ),
    "parse_run_log": _with(
        _LOGS, _LINE_ROWS,
        ("stamped", f"SELECT *, nullif({_STAMP}, '') AS stamp FROM line_rows"),
        (
            "placed",
            "SELECT *, max(CASE WHEN stamp IS NOT NULL THEN line_no END) OVER "
            "(PARTITION BY run_id, stream ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS entry_line FROM stamped",
        ),
        body="SELECT p.run_id, p.stream, p.line_no, p.entry_line, s.stamp AS logged_at, p.line_no - p.entry_line AS part, "
        f"CASE WHEN p.stamp IS NULL THEN p.line ELSE regexp_replace(p.line[24:], '{_BLANK}+\\z', '') END AS message "
        "FROM placed p LEFT JOIN stamped s ON s.run_id = p.run_id AND s.stream = p.stream AND s.line_no = p.entry_line",
    ),
    "classify_launch_errors": _with(
        ("errors", B.LAUNCH_ERRORS.sql()),
        body="SELECT run_id, CASE WHEN regexp_matches(lower(message), 'balance|funds|payment') THEN 'balance' "
        "WHEN contains(message, 'remote job failed with exit code') THEN 'remote_job' "
        "WHEN contains(message, 'create network volume:') AND contains(message, 'not found or does not support network volumes') THEN 'volume' "
        "WHEN contains(message, 'create pod: could not find any pods with required specifications') THEN 'pod' "
        f"ELSE 'other' END AS error_class, array_to_string([trim(d) FOR d IN string_split(regexp_extract(message, '{_CENTERS}', 1), ',')], '|') "
        "AS data_centers FROM errors",
    ),
    "ssh_endpoints": _with(
        _SNAPSHOTS, _STATES_OF_PODS,
        body="SELECT pod_id, provider, payload, host, CASE WHEN host IS NOT NULL THEN port END AS port FROM pod_states",
    ),
    "pod_readiness": _with(
        _SNAPSHOTS, _STATES_OF_PODS, _POD_TIMES,
        (
            "decided",
            "SELECT *, date_diff('microsecond', t0, observed_ts) / 1E6 < wait_limit AS in_time FROM pod_times "
            "WHERE state <> 'pending' QUALIFY row_number() OVER (PARTITION BY pod_id ORDER BY observed_ts, state) = 1",
        ),
        body="SELECT t.pod_id, t.provider, t.snapshots, CASE WHEN d.in_time THEN d.state "
        "WHEN date_diff('microsecond', t.t0, t.t1) / 1E6 >= t.wait_limit THEN 'timeout' ELSE 'pending' END AS state, "
        "CASE WHEN d.in_time AND d.state = 'ready' THEN d.host END AS host, "
        "CASE WHEN d.in_time AND d.state = 'ready' THEN d.port END AS port "
        "FROM (SELECT DISTINCT pod_id, provider, snapshots, t0, t1, wait_limit FROM pod_times) t "
        "LEFT JOIN decided d USING (pod_id)",
    ),
}
