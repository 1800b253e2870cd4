import json
import tarfile

import pytest

from slipway import session
from slipway.operators import code, offers, settings, sizing
from slipway.operators.logs import log_tail as tail
from slipway.operators.logs import stdout_tail
from slipway.sources import landed, sinks


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_offers(spark, tmp_path):
    page = {"items": [
        {"cloudId": "c1", "gpuType": "A100", "socket": "S", "provider": "p", "gpuMemory": 80, "gpuCount": 1,
         "stockStatus": "High", "isSpot": False, "prices": {"onDemand": 1.5}, "images": ["i"], "disk": {"min": 40, "max": 500},
         "security": "secure_cloud", "dataCenter": "EU", "unknown": 1},
        {"cloudId": "c2", "gpuMemory": "80", "gpuCount": 1, "prices": {"communityPrice": 2}, "security": "secure_cloud"},
        None,
    ], "totalCount": 2}
    write(tmp_path / "a.json", json.dumps(page) + "\n" + json.dumps({"other": 1}))
    frame = landed.read_offers(spark, str(tmp_path / "a.json"))
    assert frame.count() == 2
    listed = offers.list_offers(frame, min_vram_gb=10, max_dollars_per_hour=None, cloud_type="").collect()
    # A memory that is text is no number, so the second offer does not count.
    assert [(r.label, r.disk_max_gb, r.data_center) for r in listed] == [("A100 (p/c1)", 500.0, "EU")]


def test_hub_metadata(spark, tmp_path):
    write(tmp_path / "files.json", {"id": "m", "siblings": [
        {"rfilename": "a.safetensors", "size": 2**30}, {"path": "b.bin", "size": 2**30}, {"filename": "c.txt", "size": 5}, {}]})
    files = landed.read_model_files(spark, str(tmp_path / "files.json"))
    assert sizing.weight_file_rollup(files).first().size_gb == 2.0
    write(tmp_path / "tensors.json", {"id": "m", "parameter_count": {"F32": 3, "I4": 1}})
    counted = sizing.param_rollup(landed.read_tensor_counts(spark, str(tmp_path / "tensors.json"))).first()
    assert (counted.param_count, counted.weight_bytes) == (4, 12)
    write(tmp_path / "hub/org/m/config.json", '{"hidden_size":\n 8}')
    configs = landed.read_model_configs(spark, str(tmp_path / "hub"))
    found = sizing.extract_architecture(configs).first()
    assert (found.model_id, found.hidden_size) == ("org/m", 8)
    write(tmp_path / "hub/gpt2/config.json", "{}")
    configs = landed.read_model_configs(spark, str(tmp_path / "hub"))
    assert {r.model_id for r in configs.collect()} == {"org/m", "gpt2"}


def test_volumes(spark, tmp_path):
    write(tmp_path / "v.json", {"volumes": [{"id": "v1", "name": "n", "dataCenterId": "EU", "size": 5}, None, {"id": "v2"}]})
    rows = landed.read_volumes(spark, str(tmp_path / "v.json")).collect()
    assert [(r.volume_id, r.seq) for r in rows] == [("v1", 0), ("v2", 2)]


def test_settings_files(spark, tmp_path):
    write(tmp_path / "run1/job.json", '{"model_id": "a/b",\n "vram_gb": 80, "command": null, "auto_network_volume": true}')
    write(tmp_path / "run2/job.json", "[1]")
    rows = landed.read_settings(spark, str(tmp_path), layer=2)
    assert {(r.run_id, r.key) for r in rows.collect()} == {
        ("run1", "model_id"), ("run1", "vram_gb"), ("run1", "command"), ("run1", "auto_network_volume"), ("run2", None)}
    write(tmp_path / "run3/job.json", "{}")
    config = {c.run_id: c for c in settings.overlay_settings(landed.read_settings(spark, str(tmp_path), layer=2)).collect()}
    one = config["run1"]
    assert (one.model_id, one.vram_gb, one.command, one.auto_network_volume) == ("a/b", 80, "", True)
    assert config["run2"].vram_gb == 24 and "cannot be read" in config["run2"].reject_reason
    assert config["run3"].vram_gb == 24 and config["run3"].reject_reason is None


def test_logs_and_code(spark, tmp_path):
    write(tmp_path / "results/r1/logs/stdout.log", "a\nb")
    write(tmp_path / "results/r1/logs/stderr.log", "oops")
    write(tmp_path / "results/r1/other.txt", "no")
    write(tmp_path / "results/r1/client.log", "[2024-01-01T00:00:00Z] started")
    client = landed.read_client_logs(spark, str(tmp_path / "results")).collect()
    assert [tuple(r) for r in client] == [("r1", "client", "[2024-01-01T00:00:00Z] started")]
    logs = {(r.run_id, r.stream): r.text for r in landed.read_run_logs(spark, str(tmp_path / "results")).collect()}
    assert logs == {("r1", "stdout"): "a\nb", ("r1", "stderr"): "oops"}
    write(tmp_path / "code/p1/code/run.py", "é = 1")
    write(tmp_path / "code/p2/a/run.sh", "x")
    tree = {(r.project_id, r.rel_path): r.content for r in landed.read_code_tree(spark, str(tmp_path / "code")).collect()}
    assert tree == {("p1", "code/run.py"): "é = 1", ("p2", "a/run.sh"): "x"}
    (tmp_path / "code/p2/image.bin").write_bytes(bytes(range(256)))
    (tmp_path / "code/p2/bad.py").write_bytes(b"\xff = 1")
    tree = landed.read_code_tree(spark, str(tmp_path / "code"))
    states = {(r.project_id, r.rel_path): r.state for r in code.check_syntax(tree).collect()}
    assert states == {("p1", "code/run.py"): "ok", ("p2", "a/run.sh"): "unchecked", ("p2", "bad.py"): "error"}
    assert tree.count() == 4


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    expected = {}
    for run, count in (("r1", 3000), ("r2", 1), ("r3", 700)):
        lines = [f"{run} line {n} " + "x" * (n % 90) for n in range(1, count + 1)]
        write(tmp_path / f"results/{run}/logs/stdout.log", "\n".join(lines) + "\n")
        expected.update({(run, "stdout", n): line for n, line in enumerate(lines, 1)})
    write(tmp_path / "results/r1/client.log", "not this one")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = landed.read_log_lines(spark, str(tmp_path / "results"))
        rows = frame.collect()
        tails = {r.run_id: (r.total_lines, r.truncated) for r in stdout_tail(frame).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tails == {"r1": (3000, True), "r2": (1, False), "r3": (700, True)}
    assert {(r.run_id, r.stream, r.line_no): r.line for r in rows} == expected and len(rows) == len(expected)


def test_log_tails_of_a_stream_become_events(spark, tmp_path):
    table = str(tmp_path / "events")

    def drain():
        tails = tail(landed.read_run_logs(spark, str(tmp_path / "results"), stream=True))
        events = tails.select("run_id", "kind", "message")
        sinks.stream_events(events, table, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    write(tmp_path / "results/r1/logs/stdout.log", " a\nb\n")
    drain()
    write(tmp_path / "results/r2/logs/stderr.log", "oops")
    drain()
    rows = {tuple(r) for r in spark.read.parquet(table).collect()}
    assert rows == {("r1", "output", "a\nb"), ("r2", "error", "oops")}


def test_code_archives_have_hidden_files(spark, tmp_path):
    write(tmp_path / "src/.env", "x")
    write(tmp_path / "src/pkg/__init__.py", "def broken(:")
    write(tmp_path / "src/run.py", "")
    (tmp_path / "in").mkdir()
    with tarfile.open(tmp_path / "in/p1.tar.gz", "w:gz") as archive:
        archive.add(tmp_path / "src", arcname=".")
    (tmp_path / "in/p2.tar.gz").write_bytes(b"no archive")
    (tmp_path / "in/p3.tar.gz").write_bytes((tmp_path / "in/p1.tar.gz").read_bytes()[:40])
    tree = landed.read_code_archives(spark, str(tmp_path / "in"))
    broken = {(r.project_id, r.rel_path) for r in tree.collect() if r.project_id != "p1"}
    assert broken == {("p2", None), ("p3", None)}
    tree = tree.filter("project_id = 'p1'")
    found = {(r.project_id, r.rel_path): r.content for r in tree.collect()}
    assert found == {("p1", ".env"): "x", ("p1", "pkg/__init__.py"): "def broken(:", ("p1", "run.py"): ""}
    assert {r.rel_path for r in code.select_bundle_files(tree).collect()} == {"pkg/__init__.py", "run.py"}
    assert code.verify_projects(tree).first().error_files == 1


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("b", None)], "z string, a int")
    sinks.write_json(frame, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"z":"b"}'
    for _ in range(2):
        sinks.append_events(frame, str(tmp_path / "t"))
    sinks.write_table(frame, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_shared_folder(spark):
    assert session.shared_dir(spark)


class _Cluster:
    """A session without a shared folder, as far as ``shared_dir`` looks."""

    master = "spark://somewhere"

    @property
    def conf(self):
        return self

    @property
    def sparkContext(self):
        return self

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return None


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError):
        session.shared_dir(_Cluster())
