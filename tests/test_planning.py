import string

import pytest
from pyspark.sql import functions as F

from slipway import constants as C
from slipway import schemas as S
from slipway.functions import text as X
from slipway.operators import code, planning, settings, sizing
from test_offers import offer

GIB = 1024**3


def one(spark, function, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    frame = spark.createDataFrame([values], schema)
    return frame.select(function(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


def configs(spark, *runs):
    """Run configs from dicts of settings, through the overlay."""
    rows = [(run["run_id"], 3, 0, key, str(value)) for run in runs for key, value in run.items() if key != "run_id"]
    rows += [(run["run_id"], 0, 0, "poll_seconds", "20") for run in runs]
    return settings.overlay_settings(spark.createDataFrame(rows, S.SETTINGS_ROWS))


def test_layers(spark):
    rows = [
        ("a", 2, "model_id", "From/File"), ("a", 2, "vram_gb", "80"), ("a", 3, "model", "From/Kwarg"),
        ("b", 3, "model_id", None), ("b", 3, "command", ""), ("b", 1, "provider", "x"), ("b", 2, "provider", None),
        ("c", 1, "command", "one"), ("c", 2, "command", ""), ("c", 2, "unknown", "9"), ("c", 1, "vram_gb", "48"),
        ("c", 2, "max_spend", "3"), ("c", 3, "max_spend", "7.5"), ("c", 3, "keep_pod_on_success", "true"),
        ("d", 1, "vram_gb", "lots"), ("d", 0, "gpu_count", "2"),
        ("e", 1, "unknown", "1"), ("f", 2, "command", None), ("g", 1, None, None), ("g", 0, "command", "x"),
        ("h", 1, "command", "9"), ("h", 1, "command", "80"), ("h", 1, "command", "7"), ("h", 1, "command", None),
    ]
    rows = [(run_id, layer, seq, key, value) for seq, (run_id, layer, key, value) in enumerate(rows)]
    cleaned = settings.clean_overrides(spark.createDataFrame(rows, S.SETTINGS_ROWS))
    found = {r.run_id: r for r in settings.overlay_settings(cleaned).collect()}
    assert (found["a"].model_id, found["a"].vram_gb) == ("From/Kwarg", 80)
    assert (found["b"].model_id, found["b"].provider, found["b"].command) == ("", "x", "")
    assert (found["c"].command, found["c"].vram_gb, found["c"].max_spend_dollars) == ("", 48, 7.5)
    assert found["c"].keep_pod_on_success is True
    assert found["d"].vram_gb == 24 and found["d"].reject_reason == "vram_gb is not a int"
    assert found["d"].gpu_count == 2
    # Runs that set nothing have the defaults, unreadable settings are reported, later entries win.
    assert found["e"].vram_gb == found["f"].vram_gb == 24 and found["e"].reject_reason is None
    assert found["g"].command == "x" and "cannot be read" in found["g"].reject_reason
    assert found["h"].command == "7"
    for name, _, default in C.SETTINGS:
        if name not in ("model_id", "vram_gb"):
            assert found["a"][name] == default


@pytest.mark.parametrize(
    "model, slug",
    [
        ("Org/Test Model", "org-test-model"), ("  Qwen/Qwen2.5-7B ", "qwen-qwen2.5-7b"), ("--", "model"),
        ("", "model"), ("　É!x_\x1c", "é-x_"), ("a//b", "a--b"), ("٣½", "٣½"),
    ],
)
def test_slug(spark, model, slug):
    assert one(spark, X.model_slug, model) == slug


def test_templates(spark):
    frame = spark.createDataFrame(
        [("run-123", "Org/Test Model", "${X}/{model_slug}/{run_id}"),
         ("r", "{run_id}", "$Y|{model_id}|{nope}|{{x}}|$NOPE|${NOPE}|{timestamp}|${}"),
         ("r2", "", None)],
        "run_id string, model_id string, results_dir string",
    )
    found = {r.run_id: r.results_dir for r in settings.expand_templates(frame, {"X": "/tmp/x", "Y": "{run_id}"}).collect()}
    assert found["run-123"] == "/tmp/x/org-test-model/run-123"
    # One pass each: what a variable brings is filled, what a key brings is not.
    assert found["r"] == "r|{run_id}|{nope}|{x}|$NOPE|${NOPE}|r|${}"
    assert found["r2"] is None


def test_provider(spark):
    for given, expected in ((" RunPod", "runpod"), ("", "runpod"), ("PrimeIntellect\t", "primeintellect"), ("aws", None)):
        assert one(spark, X.normalize_provider, given) == expected


def test_strip_knows_all_white_space(spark):
    every = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert set(every) == set(C.WHITE_SPACE)
    assert one(spark, X.strip, every + "a b" + every) == "a b"
    assert one(spark, X.strip, every) == ""


FILES = [
    ("dir", None, "run.py", "print('hello')"),
    ("dir", None, "main.py", "x = 1"),
    ("dir", None, "lib/bad.py", "def broken(:"),
    ("dir", None, "lib-a/worse.py", "1 +"),
    ("dir", None, ".git/hooks/x.py", "def broken(:"),
    ("dir", None, "go.sh", "if"),
    ("dir", None, ".env", ""),
    ("dir", None, ".env.production", ""),
    ("dir", None, ".envrc", ""),
    ("dir", None, "sub/.env/x", ""),
    ("dir", None, "runpod_results/a.txt", ""),
    ("dir", None, ".py", "not ( python"),
    ("dir", None, "nul.py", "a\x00b"),
    ("single", "run.py", "run.py", "print(1)"),
    ("single", "run.py", "requirements.txt", "torch"),
    ("single", "run.py", "other.py", "def broken(:"),
    ("odd", "notes.txt", "notes.txt", ""),
    ("none", None, "readme.md", ""),
    ("shell", None, "run.sh", ""),
]


@pytest.fixture()
def files(spark):
    return spark.createDataFrame(FILES, S.CODE_FILES)


def test_code_files(files):
    picked = {(r.project_id, r.rel_path) for r in code.select_code_files(files).collect()}
    assert picked == {
        ("dir", "run.py"), ("dir", "main.py"), ("dir", "lib/bad.py"), ("dir", "lib-a/worse.py"), ("dir", "go.sh"),
        ("dir", "nul.py"), ("single", "run.py"), ("odd", "notes.txt"), ("shell", "run.sh"),
    }
    shipped = {(r.project_id, r.rel_path) for r in code.select_bundle_files(files).collect()}
    assert {p for project, p in shipped if project == "dir"} == {
        "run.py", "main.py", "lib/bad.py", "lib-a/worse.py", "go.sh", ".envrc", ".py", "nul.py",
    }
    assert {p for project, p in shipped if project == "single"} == {"run.py", "requirements.txt"}


def test_syntax_and_commands(files):
    states = {(r.project_id, r.rel_path): (r.state, r.error) for r in code.check_syntax(files).collect()}
    assert states[("dir", "run.py")] == ("ok", None)
    assert states[("dir", "lib/bad.py")][0] == "error"
    assert states[("dir", "lib/bad.py")][1].startswith("lib/bad.py: ")
    assert states[("dir", "nul.py")][0] == "error"
    assert states[("dir", "go.sh")] == ("unchecked", None)
    commands = {r.project_id: (r.command, r.reject_reason) for r in code.infer_command(files, "/r").collect()}
    assert commands["dir"] == ("python /r/run.py", None)
    assert commands["single"] == ("python /r/run.py", None)
    assert commands["shell"] == ("bash /r/run.sh", None)
    assert commands["odd"] == (None, C.NO_COMMAND_FOR_FILE)
    assert commands["none"] == (None, C.NO_COMMAND_FOR_DIR)
    verdicts = {r.project_id: r for r in code.verify_projects(files).collect()}
    assert (verdicts["dir"].ok, verdicts["dir"].checked_files, verdicts["dir"].error_files) == (False, 6, 3)
    # Path order goes part by part: "lib" comes before "lib-a".
    assert verdicts["dir"].first_error.startswith("lib/bad.py: ")
    assert verdicts["single"].ok and verdicts["shell"].ok and not verdicts["none"].ok


def test_main_py_comes_after_run_py(spark):
    frame = spark.createDataFrame(
        [("a", None, "run.sh", ""), ("a", None, "main.py", ""), ("b", None, "sub/run.py", ""), ("b", None, "run.sh", "")],
        S.CODE_FILES,
    )
    found = {r.project_id: r.command for r in code.infer_command(frame, "/r").collect()}
    assert found == {"a": "python /r/main.py", "b": "bash /r/run.sh"}


def volume_plan(spark, run, volumes=(), sizes=(("org/m", 30.0),)):
    asked = settings.expand_templates(configs(spark, {"run_id": "r", **run}))
    size_frame = spark.createDataFrame(list(sizes), "model_id string, size_gb double")
    return planning.plan_volume(asked, size_frame, spark.createDataFrame(list(volumes), S.VOLUMES)).first()


AUTO = {"model_id": "org/m", "auto_network_volume": "true", "network_volume_data_center_id": "EU-RO-1"}


def test_volume_plans(spark):
    made = volume_plan(spark, AUTO)
    assert (made.volume_action, made.volume_size_gb, made.volume_name, made.model_size_gb) == ("create", 75, "job-org-m", 30.0)
    same = [("v2", "job-org-m", "EU-RO-1", 9, 5), ("v1", "job-org-m", "EU-RO-1", 9, 2), ("v0", "job-org-m", "US", 9, 1)]
    reused = volume_plan(spark, AUTO, same)
    assert (reused.volume_action, reused.volume_id) == ("reuse", "v1")
    given = volume_plan(spark, {**AUTO, "network_volume_id": " v9 "}, same)
    assert (given.volume_action, given.volume_id, given.plan_volume_size_gb) == ("use", "v9", None)
    assert volume_plan(spark, {**AUTO, "network_volume_data_center_id": " "}).volume_action == "error"
    assert volume_plan(spark, {"model_id": "org/m"}).volume_action == "none"
    unknown = volume_plan(spark, {**AUTO, "model_id": "org/other"})
    assert (unknown.volume_size_gb, unknown.model_size_gb) == (160, None)
    sized = volume_plan(spark, {**AUTO, "network_volume_size_gb": "300"})
    assert (sized.volume_size_gb, sized.model_size_gb) == (300, None)
    blank = volume_plan(spark, {"auto_network_volume": "true", "network_volume_data_center_id": "X", "pod_volume_gb": "40"})
    assert blank.volume_size_gb == 50
    long_name = volume_plan(spark, {**AUTO, "network_volume_name": "n" * 300})
    assert long_name.volume_name == "n" * 191
    other = volume_plan(spark, {**AUTO, "provider": "primeintellect", "network_volume_size_gb": "300"}, same)
    assert (other.volume_action, other.plan_volume_size_gb, other.volume_options_ignored) == ("none", None, True)


def test_plans(spark, files):
    runs = [
        {"run_id": "ok", "code": "single", "vram_gb": 48, "max_dollars_per_hour": 2.0, "model_id": "org/m"},
        {"run_id": "own", "code": "none", "command": " python x.py "},
        {"run_id": "bad code", "code": "dir"},
        {"run_id": "no command", "code": "none"},
        {"run_id": "no code"},
        {"run_id": "gone", "code": "missing"},
        {"run_id": "cloud", "code": "single", "provider": "aws"},
        {"run_id": "small cap", "code": "single", "max_dollars_per_hour": 1.0, "gpu_count": 4},
        {"run_id": "market", "code": "single", "provider": "PrimeIntellect", "vram_gb": 48, "gpu_count": 4,
         "max_dollars_per_hour": 12.0, "auto_network_volume": "true"},
        {"run_id": "no market", "code": "single", "provider": "primeintellect", "gpu_count": 8},
    ]
    market = [offer(gpu_count=4, price=2.0, cloud=f"c{i}") for i in range(10)]
    sizes = spark.createDataFrame([("org/m", 30.0)], "model_id string, size_gb double")
    plans = planning.make_plan(
        configs(spark, *runs), files, spark.createDataFrame(market, S.GPU_OFFERS), sizes,
        spark.createDataFrame([], S.VOLUMES), run_root="/r",
    )
    found = {r.run_id: r for r in plans.collect()}
    assert len(found) == len(runs)
    ok = found["ok"]
    assert ok.reject_reason is None and ok.command == "python /r/run.py" and ok.verified_file_count == 1
    assert ok.gpu_candidates[0] == "NVIDIA A40" and ok.estimated_hourly_dollars == 1.22
    assert ok.results_dir == "runpod_results/ok" and ok.model_size_gb is None
    assert found["own"].command == "python x.py" and found["own"].reject_reason is None
    market_plan = found["market"]
    assert market_plan.gpu_candidates == [f"A100_80GB (hyperstack/c{i})" for i in range(8)]
    assert market_plan.estimated_hourly_dollars == 8.0 and market_plan.network_volume_id == ""
    starts = {
        "bad code": "code has errors: lib/bad.py", "no command": C.NO_COMMAND_FOR_DIR, "no code": "no code",
        "gone": "no such code: ", "cloud": "unknown provider: ", "small cap": "nothing on offer for 4 x 24 GB",
        "no market": "nothing on offer for",
    }
    for run_id, start in starts.items():
        assert found[run_id].reject_reason.startswith(start), run_id
    summary = planning.plan_summary(plans)
    assert len(summary.columns) == 12
    assert {r.run_id: r.verified_files for r in summary.collect()} == {"ok": ["run.py"], "own": [], "market": ["run.py"]}


def test_hot_model_and_project(spark, files):
    """Most runs share one model, project and volume; the salted lookups still find them."""
    rows = []
    for i in range(300):
        for key, value in (("code", "single"), ("model_id", "org/m"), ("auto_network_volume", "true"),
                           ("network_volume_data_center_id", "EU-RO-1")):
            rows.append((f"r{i}", 3, 0, key, value if i % 3 else f"{value}{i}" if key == "model_id" else value))
    asked = settings.expand_templates(settings.overlay_settings(spark.createDataFrame(rows, S.SETTINGS_ROWS)))
    volumes = spark.createDataFrame([("v1", "job-org-m", "EU-RO-1", 9, 2)], S.VOLUMES)
    sizes = spark.createDataFrame([("org/m", 30.0)], "model_id string, size_gb double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = planning.make_plan(asked, files, spark.createDataFrame([], S.GPU_OFFERS), sizes, volumes)
        found = {r.run_id: r for r in plans.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(found) == 300
    for i in range(300):
        row = found[f"r{i}"]
        assert row.volume_action == ("reuse" if i % 3 else "create")
        assert row.network_volume_size_gb == (75 if i % 3 else 160)
        assert row.verified_file_count == 1


def test_fixed_names_are_plain(spark):
    assert len(C.SETTINGS) == 26
    assert all(set(name) <= set(string.ascii_lowercase + "_") for name in C.SETTING_NAMES)


def test_size_feeds_volume(spark):
    files = spark.createDataFrame([("org/m", "a.safetensors", 22 * GIB)], S.MODEL_FILES)
    planned = planning.plan_volume(
        configs(spark, {"run_id": "r", **AUTO}), sizing.weight_file_rollup(files), spark.createDataFrame([], S.VOLUMES)
    )
    assert planned.first().volume_size_gb == 55
