"""The engine's tables as views of the given ones.

The expressions are SQL that Spark and DuckDB read alike, so that a query and the SQL it
is checked against start from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Binding:
    source: str
    columns: dict[str, str]
    where: str | None = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source)
        if self.where:
            rows = rows.filter(self.where)
        return rows.select(*(F.expr(text).alias(name) for name, text in self.columns.items()))

    def sql(self) -> str:
        picked = ", ".join(f"{text} AS {name}" for name, text in self.columns.items())
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {picked} FROM {self.source}{where}"


def cases(number: str, *values: str) -> str:
    """``values`` chosen in turn by ``number`` modulo how many there are."""
    arms = " ".join(f"WHEN {place} THEN {value}" for place, value in enumerate(values))
    return f"CASE {number} % {len(values)} {arms} END"


def text(number: str) -> str:
    return f"CAST({number} AS STRING)"


# A dollar sign that Spark's own variable substitution in SQL text does not see.
DOLLAR = "' || chr(36) || '"


def whole(number: str) -> str:
    return f"CAST(floor({number}) AS BIGINT)"


MODEL_FILES = Binding(
    "lineitem",
    {
        "model_id": f"'org/model-' || {text('l_partkey')}",
        "file_name": f"'model-' || {text('l_linenumber')} || CASE "
        "WHEN l_partkey % 23 = 4 THEN '.md' "
        "WHEN l_returnflag = 'A' THEN '.safetensors' "
        "WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN '.BIN' "
        "WHEN l_returnflag = 'N' THEN '-Optimizer.pt' "
        "WHEN l_linenumber = 1 THEN '.gguf' "
        "WHEN l_linenumber = 2 THEN '.pth' ELSE '.bin.txt' END",
        "size_bytes": f"CASE WHEN l_linenumber = 5 THEN -1 WHEN l_linenumber = 6 THEN NULL "
        f"ELSE {whole('l_quantity')} * 268435456 + l_linenumber END",
    },
)

ASKED_MODELS = Binding(
    "part",
    {
        "model_id": "CASE WHEN p_partkey % 13 = 0 THEN 'org/absent-' ELSE 'org/model-' END || "
        + text("p_partkey")
    },
)

TENSOR_COUNTS = Binding(
    "lineitem",
    {
        "model_id": f"'org/model-' || {text('l_partkey')}",
        "dtype": cases("l_linenumber", "'BF16'", "'f32'", "'I8'", "'F4'", "'NEW_TAG'", "'u4'", "'F64'"),
        # Models whose counts add up to nothing have no spec of this source.
        "param_count": f"CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE {whole('l_extendedprice * 1E4')} END",
    },
)

_HIDDEN = text("(p_size + 1) * 128")
_LAYERS = text("8 + p_size % 40")
_HEADS = text("1 + p_size % 31")
_KV = text("1 + p_size % 8")
_CONTEXT = text("1024 * (1 + p_size % 64)")


def _json(pattern: str) -> str:
    """SQL text of a JSON pattern in which H, L, A, K and M in angle brackets are numbers."""
    quoted = f"'{pattern}'"
    for mark, number in (("<H>", _HIDDEN), ("<L>", _LAYERS), ("<A>", _HEADS), ("<K>", _KV), ("<M>", _CONTEXT)):
        quoted = quoted.replace(mark, f"' || {number} || '")
    return quoted


MODEL_CONFIGS = Binding(
    "part",
    {
        "model_id": f"'org/model-' || {text('p_partkey')}",
        "config_json": cases(
            "p_partkey",
            _json(
                '{"hidden_size": <H>, "num_hidden_layers": <L>, "num_attention_heads": <A>, '
                '"num_key_value_heads": <K>, "max_position_embeddings": <M>}'
            ),
            _json('{"n_embd": <H>, "n_layer": <L>, "n_head": <A>, "n_positions": <M>}'),
            _json(
                '{"hidden_size": 1024, "vision_config": {"hidden_size": 1}, "text_config": '
                '{"hidden_size": <H>, "num_hidden_layers": <L>, "num_attention_heads": <A>}}'
            ),
            _json(
                '{"hidden_size": "4096", "d_model": <H>, "num_layers": 12.0, "n_layer": <L>, '
                '"head_dim": 64, "num_attention_heads": -3, "n_head": <A>}'
            ),
            _json('{"hidden_size": 1024, "num_hidden_layers": <L>, "text_config": {"hidden_size": null}}'),
            "'[1, 2]'",
            "'not json'",
            "NULL",
            _json(
                '{"hidden_size": true, "num_hidden_layers": <L>, "head_dim": 128, '
                '"num_key_value_heads": <K>, "max_seq_len": <M>, "text_config": "x"}'
            ),
            "'{}'",
        ),
    },
)

MODEL_SPECS = Binding(
    "part",
    {
        "model_id": f"'org/model-' || {text('p_partkey')}",
        "param_count": f"{whole('p_retailprice * 1E7')} + p_partkey",
        "weight_bytes": f"({whole('p_retailprice * 1E7')} + p_partkey) * "
        + cases("p_partkey", "2", "4", "1", "8"),
        "hidden_size": "CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE CAST((p_size + 1) * 128 AS BIGINT) END",
        "num_layers": "CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE CAST(8 + p_size % 40 AS BIGINT) END",
        "num_kv_heads": "CAST(1 + p_size % 8 AS BIGINT)",
        "head_dim": "CASE WHEN p_partkey % 15 = 2 THEN NULL ELSE CAST(128 AS BIGINT) END",
        "max_context": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(1024 * (1 + p_size % 64) AS BIGINT) END",
        "source": cases("p_partkey", "'safetensors'", "'safetensors'", "'file-size'"),
        "goal": cases("p_partkey", "'inference'", "' LoRA '", "'qlora'", "'FULL'", "'full'", "'distill'", "'lora'"),
        "context_len": "CASE WHEN p_partkey % 9 = 0 THEN CAST(4096 AS BIGINT) END",
        "batch_size": "CAST(1 + p_partkey % 3 AS BIGINT)",
    },
)

_SEVENTH = whole("c_custkey / 7")
RUN_REQUESTS = Binding(
    "customer",
    {
        "run_id": f"'run-' || {text('c_custkey')}",
        "vram_gb": cases("c_custkey", "24", "48", "80", "94", "141", "180", "200"),
        "max_dollars_per_hour": "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 11 = 1 "
        "THEN 0E0 ELSE CAST(c_custkey % 10 AS DOUBLE) END",
        "cloud_type": cases("c_custkey", "'community'", "'SECURE'", "'ALL'"),
        "gpu_count": cases(_SEVENTH, "1", "2", "4", "8", "0"),
    },
)

GPU_QUOTES = Binding(
    "supplier",
    {
        "offer_id": "s_suppkey",
        "gpu_id": cases("s_suppkey", "'NVIDIA L4'", "'NVIDIA H200'", "'NVIDIA Unknown'", "'AMD Instinct MI300X OAM'"),
        "cloud_type": cases("s_suppkey", "'Community'", "'SECURE'", "'ALL'"),
        "planned_hourly": cases("s_suppkey", "NULL", "s_acctbal / 1000E0", "0E0", "2.5E0", "NULL"),
    },
)

GPU_OFFERS = Binding(
    "supplier",
    {
        "cloud_id": f"'c-' || {text('s_suppkey')}",
        "gpu_type": "CASE WHEN s_suppkey % 37 = 5 THEN NULL ELSE "
        + cases(
            "s_suppkey",
            "'RTX4090_24GB'", "'A40_48GB'", "'L40S_48GB'", "'A100_80GB'",
            "'H100_80GB'", "'H100_NVL_94GB'", "'H200_141GB'", "'B200_180GB'",
        )
        + " END",
        "socket": "'SXM4'",
        "provider": cases("s_suppkey", "'hyperstack'", "'lambda'", "'runpod'"),
        "security": cases("s_suppkey", "'secure_cloud'", "'community_cloud'", "'secure_cloud'", "NULL", "'community_cloud'"),
        "data_center": "CASE WHEN s_nationkey % 2 = 0 THEN 'EU-RO-1' END",
        "region": text("s_nationkey"),
        "country": "'RO'",
        "gpu_memory": "CAST(" + cases("s_suppkey", "24", "48", "48", "80", "80", "94", "141", "180") + " AS DOUBLE)",
        "gpu_count": cases(whole("s_suppkey / 8"), "1", "2", "4"),
        "stock_status": cases("s_suppkey", "'High'", "'Low'", "NULL", "'Available'", "'High'", "'UnAvailable'"),
        "is_spot": "CASE WHEN s_suppkey % 7 = 3 THEN TRUE WHEN s_suppkey % 7 = 4 THEN NULL ELSE FALSE END",
        "price_on_demand": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal / 1000E0 END",
        "price_community": "CASE WHEN s_suppkey % 18 = 0 THEN 1.25E0 END",
        "quoted_hourly": cases("s_suppkey", "NULL", "s_acctbal / 500E0", "0E0", "NULL"),
        "images": "CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE split("
        + cases(
            "s_suppkey",
            "'ubuntu_22_cuda_12,cuda_12_4_pytorch_2_5'",
            "'cuda_11_8,ubuntu_20'",
            "'cuda_12_1_pytorch_2_2,cuda_12_6_pytorch_2_7,x'",
        )
        + ", ',') END",
        "disk_min_gb": "CASE WHEN s_suppkey % 6 <> 0 THEN 40.9E0 END",
        "disk_max_gb": "CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey % 40 AS DOUBLE) * 20E0 END",
    },
)

_TWENTIETH = whole("o_orderkey / 20")
SETTINGS = Binding(
    "orders",
    {
        "run_id": f"'run-' || {text('o_custkey')}",
        "layer": f"CAST({_TWENTIETH} % 4 AS INT)",
        "seq": "CAST(o_orderkey * 7919 % 100003 AS BIGINT)",
        # Some runs set nothing that is known, some have a file that could not be read.
        "key": "CASE WHEN o_custkey % 50 = 7 THEN 'no_such_setting' WHEN o_custkey % 41 = 3 AND o_orderkey % 3 = 0 "
        "THEN NULL ELSE " + cases(
            "o_orderkey",
            "'model_id'", "'vram_gb'", "'gpu_count'", "'max_dollars_per_hour'", "'provider'",
            "'cloud_type'", "'code'", "'auto_network_volume'", "'network_volume_data_center_id'", "'model'",
            "'max_spend'", "'no_such_setting'", "'results_dir'", "'command'", "'network_volume_id'",
            "'network_volume_size_gb'", "'pod_volume_gb'", "'code'", "'code'", "'auto_network_volume'",
        )
        + " END",
        "value": cases(
            "o_orderkey",
            f"'org/model-' || {text('o_custkey % 200')}",
            cases(_TWENTIETH, "'24'", "'80'", "'48'", "'many'", "'500'"),
            cases(_TWENTIETH, "'1'", "'2'", "'4'"),
            cases(_TWENTIETH, "'2.5'", "'9'", "'0'", "'30'"),
            cases(_TWENTIETH, "' PrimeIntellect'", "'runpod'", "'aws'", "''", "'primeintellect'"),
            cases(_TWENTIETH, "'COMMUNITY'", "'SECURE'", "'ALL'"),
            f"'proj-' || {text('o_orderkey % 60 * 5')}",
            cases(_TWENTIETH, "'true'", "'false'", "'true'"),
            cases(_TWENTIETH, "'EU-RO-1'", "'US-KS-2'", "' '"),
            f"'org/model-' || {text('o_custkey % 300')}",
            cases(_TWENTIETH, "'12.5'", "'3'", "''"),
            "'x'",
            cases(_TWENTIETH, f"'/data/{{model_slug}}/{DOLLAR}{{TEAM}}'", "'{cwd}/{{x}}/{other}'", "'$UNSET/{run_id}'"),
            cases(_TWENTIETH, "''", "'  '", "'python x.py --m {model_id}'", "NULL", "''", "''"),
            cases(_TWENTIETH, "''", "''", "''", "'vol-9 '"),
            cases(_TWENTIETH, "'0'", "'300'", "NULL"),
            cases(_TWENTIETH, "NULL", "'100'", "'250'"),
            f"'proj-' || {text('o_orderkey % 50 * 5')}",
            f"'proj-' || {text('o_orderkey % 30 * 5')}",
            "'true'",
        ),
    },
)

TEMPLATES = Binding(
    "customer",
    {
        "run_id": f"'run-' || {text('c_custkey')}",
        "model_id": f"' Org/' || c_name || {cases('c_custkey', "''", "' É!'", "'/{run_id}'")} || ' '",
        "results_dir": cases(
            "c_custkey",
            f"'{DOLLAR}{{HOME_DIR}}/{{model_slug}}/{{run_id}}'",
            "'$TEAM-$TEAM_2/{{literal}}/{unknown}/{timestamp}'",
            f"'{{model_id}}|{{config_dir}}|{{cwd}}|{DOLLAR}{{UNSET}}'",
            "'plain'",
            "'{run_id}{run_id}$TEAM'",
        ),
    },
)
TEMPLATE_VARIABLES = {"HOME_DIR": "/home/ann", "TEAM": "{run_id}"}
TEMPLATE_CONFIG_DIR = "/etc/jobs"
TEMPLATE_CWD = "/work/here"

MODEL_NAMES = Binding(
    "part",
    {
        "part_id": "p_partkey",
        "model_id": cases(
            "p_partkey",
            "p_brand || '/' || p_name",
            "' ' || upper(p_name) || ' (' || p_type || ') '",
            "'--/' || p_name || '_v1.5/'",
            "' / '",
            "p_name || ' É/字' || chr(9)",
        ),
    },
)

_FIFTH = whole("page_id / 5")
_FIRST_FILE = cases(
    _FIFTH,
    "'run.py'", "'main.py'", "'run.sh'", "'README.md'", "'app/run.py'", "'train.py'",
    "'run.py'", "'main.py'", "'run.sh'", "'README.md'", "'app/run.py'", "'notes.txt'",
)
_HIDDEN_FILE = cases(
    _FIFTH,
    "'.env.local'", "'.envrc'", "'conf/.env/x.txt'", "'runpod_results/x.py'", "'a/.DS_Store'", "'a/b.env'",
)
CODE_FILES = Binding(
    "pages",
    {
        "project_id": f"'proj-' || {text('page_id - page_id % 5')}",
        "entry_file": f"CASE WHEN {_FIFTH} % 12 = 5 THEN 'train.py' WHEN {_FIFTH} % 12 = 11 THEN 'notes.txt' END",
        "rel_path": "CASE page_id % 5 "
        f"WHEN 0 THEN {_FIRST_FILE} "
        "WHEN 1 THEN 'src/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || '.py' "
        f"WHEN 2 THEN {cases(_FIFTH, "'.git/hooks/pre.py'", "'lib/node_modules/a.py'", "'lib/util.bash'")} "
        f"WHEN 3 THEN {_HIDDEN_FILE} "
        f"ELSE CASE WHEN {_FIFTH} % 6 = 5 THEN 'requirements.txt' ELSE 'scripts/go.sh' END END",
        # A page's source as comment lines compiles; as it is, or after a broken line, it does not.
        "content": "CASE WHEN page_id % 9 = 4 THEN 'def broken(:' || chr(10) || html WHEN page_id % 13 = 6 THEN html "
        "ELSE '# ' || replace(replace(html, chr(13), ' '), chr(10), chr(10) || '# ') END",
    },
)

VOLUMES = Binding(
    "supplier",
    {
        "volume_id": f"'vol-' || {text('s_suppkey')}",
        "name": f"'job-org-model-' || {text('s_suppkey % 50')}",
        "data_center_id": cases("s_suppkey", "'EU-RO-1'", "'EU-RO-1'", "'US-KS-2'"),
        "size_gb": "CAST(100 + s_suppkey % 7 AS INT)",
        "seq": "CAST(1000000 - s_suppkey AS INT)",
    },
)

RUN_POLLS = Binding(
    "events",
    {
        "run_id": f"'run-' || {text('user_id')}",
        "poll_ts": "CAST(ts AS TIMESTAMP)",
        "raw_status": "CASE WHEN event_id % 97 = 0 THEN 'done:' || CASE WHEN event_type = 'error' THEN '1' "
        "WHEN event_id % 5 = 2 THEN 'x' ELSE ' 0' END "
        "WHEN event_id % 89 = 0 THEN 'missing' ELSE 'running' END",
    },
)

# Columns of the runs, over ``run_id`` (a user id) and ``billing_start`` per user.
RUN_COLUMNS = {
    "run_id": f"'run-' || {text('user_id')}",
    "pod_id": f"'pod-' || {text('user_id')}",
    "gpu_type_id": "'NVIDIA L4'",
    "billing_start": "billing_start",
    "hourly": "CAST(user_id % 4 AS DOUBLE) * 0.5E0",
    "max_spend": "CAST(user_id % 6 AS DOUBLE) * 60E0",
    "keep_pod_on_success": "user_id % 2 = 0",
}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min(F.col("ts").cast("timestamp")).alias("billing_start"))
    )
    return starts.select(*(F.expr(text).alias(name) for name, text in RUN_COLUMNS.items()))


def runs_sql() -> str:
    picked = ", ".join(f"{text} AS {name}" for name, text in RUN_COLUMNS.items())
    return f"SELECT {picked} FROM (SELECT user_id, min(ts) AS billing_start FROM events GROUP BY user_id)"


RUN_EVENTS = Binding(
    "conversations",
    {
        "run_id": f"'run-' || {text('conv_id')}",
        "seq": "turn",
        "kind": "CASE role WHEN 'user' THEN 'status' WHEN 'assistant' THEN 'output' ELSE 'error' END",
        "message": "text",
    },
)

RUN_LOGS = Binding(
    "documents",
    {
        # Every run has two streams. Some logs start and end with white space.
        "run_id": f"'run-' || {text(whole('doc_id / 2'))}",
        "stream": "CASE WHEN doc_id % 2 = 1 THEN 'stderr' ELSE 'stdout' END",
        "text": "CASE "
        "WHEN doc_id % 6 < 2 THEN chr(10) || '  ' || text || ' ' || chr(10) || chr(10) || '   ' "
        "ELSE text END",
    },
)

_STAMPED = "text"
for _letter, _second in (("A", "07"), ("E", "08"), ("T", "09"), ("L", "10")):
    _STAMPED = (
        f"replace({_STAMPED}, chr(10) || '{_letter}', chr(10) || '[2024-05-01T00:00:{_second}Z] {_letter}')"
    )
STAMPED_LOGS = Binding(
    "documents",
    {
        "run_id": f"'run-' || {text('doc_id')}",
        "stream": "'log'",
        "text": f"CASE WHEN doc_id % 3 = 0 THEN '[2024-05-01T00:00:01Z] ' ELSE '' END || {_STAMPED} || chr(10)",
    },
)

# The line a log holds at ``line_no``: every fourth one starts an entry.
LOG_LINE = (
    "CASE WHEN line_no % 4 = 2 THEN '[2024-05-01T00:00:' || lpad(CAST(line_no % 60 AS STRING), 2, '0') "
    "|| 'Z] ' || line ELSE line END"
)

LAUNCH_ERRORS = Binding(
    "orders",
    {
        "run_id": f"'run-' || {text('o_orderkey')}",
        "provider": "'runpod'",
        "message": cases(
            "o_orderkey",
            f"'Not enough BALANCE: ' || {text('o_custkey')}",
            "'remote job failed with exit code 1; see logs'",
            "'remote job failed with exit code 2: no funds'",
            "'create network volume: US-1 not found or does not support network volumes. "
            "Available data centers: EU-RO-1, US-KS-2 ,CA-1. Try again'",
            "'create pod: could not find any pods with required specifications'",
            "'create network volume: quota'",
            "'\"Available data centers: \" none'",
            "'Available data centers: A,B'",
            "'Payment required'",
        ),
    },
)

_SIXTH = whole("event_id / 6")
POD_SNAPSHOTS = Binding(
    "events",
    {
        "pod_id": f"'pod-' || {text('event_id - event_id % 6')}",
        "provider": cases(_SIXTH, "'runpod'", "'primeintellect'"),
        "observed_ts": "CAST(ts AS TIMESTAMP)",
        "payload": f"CASE {_SIXTH} % 2 WHEN 0 THEN CASE "
        "WHEN event_id % 6 < 2 THEN '{\"desiredStatus\": \"RUNNING\", \"publicIp\": \"\"}' "
        "WHEN event_id % 11 = 3 THEN '{\"desiredStatus\": \"exited \"}' "
        "WHEN event_id % 5 = 1 THEN '{\"desiredStatus\": \" running\", \"publicIp\": \"10.0.0.' || "
        f"{text('event_id % 250')} || '\", \"portMappings\": {{\"22\": ' || {text('40000 + event_id % 1000')} || '}}}}' "
        "ELSE '{\"desiredStatus\": \"RUNNING\", \"publicIp\": \"10.0.0.1\", \"portMappings\": {}}' END "
        "ELSE CASE "
        "WHEN event_id % 6 < 1 THEN '{\"status\": \"PENDING\"}' "
        "WHEN event_id % 13 = 5 THEN '{\"status\": \"ERROR\"}' "
        "WHEN event_id % 7 = 2 THEN '{\"status\": \"ACTIVE\", \"sshConnection\": \"root@135.23.125.123 -p 2222\"}' "
        "WHEN event_id % 7 = 3 THEN '{\"status\": \"ACTIVE\", \"sshConnection\": [\"no host here\", \"ubuntu@gpu-77.example.com\"]}' "
        "WHEN event_id % 7 = 4 THEN '{\"status\": \"ACTIVE\", \"sshConnection\": null, \"ip\": [\" \", \"10.0.0.5\"], "
        "\"primePortMapping\": [{\"usedBy\": \"WEB\", \"external\": 80}, {\"usedBy\": \"SSH\", \"external\": \"40002\"}]}' "
        "ELSE '{\"status\": \"ACTIVE\"}' END END",
    },
)

