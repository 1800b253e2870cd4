import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slipway import constants as C
from slipway import schemas as S
from slipway.functions import telemetry as L
from slipway.functions import text as X
from slipway.operators import logs, telemetry
from slipway.sources import sinks

T0 = datetime(2024, 5, 1)


def at(**offset):
    return T0 + timedelta(**offset)


def test_statuses(spark):
    cases = {
        "done:0": ("done", 0), "done:x": ("done", 1), " running\n": ("running", None), "missing": ("missing", None),
        "done: 7 ": ("done", 7), "done:": ("done", 1), "done:-1": ("done", -1), "done:1.0": ("done", 1), "": ("", None),
    }
    frame = spark.createDataFrame([(c,) for c in cases], "s string")
    found = frame.select("s", L.decode_status(L.status_text(F.col("s"))).alias("d")).collect()
    assert {r.s: (r.d.status, r.d.exit_code) for r in found} == cases


RUNS = [
    ("spend", 2.0, 5.0), ("done first", 2.0, 5.0), ("failed", 2.0, 5.0), ("lost", 2.0, 5.0), ("free", 0.0, 5.0),
    ("no limit", 2.0, 0.0), ("silent", 2.0, 5.0), ("late done", 2.0, 5.0), ("no price", None, 5.0),
]
POLLS = [
    ("spend", at(hours=2, minutes=29), "running"), ("spend", at(hours=2, minutes=30), "running"),
    ("spend", at(hours=3), "done:0"),
    ("done first", at(hours=2, minutes=30), "done:0"),
    ("failed", at(hours=1), "done:3"), ("failed", at(hours=2), "done:0"),
    ("lost", at(hours=1), "missing"), ("lost", at(hours=9), "running"),
    ("free", at(hours=900), "running"), ("no limit", at(hours=900), "running"), ("no price", at(hours=900), "running"),
    ("late done", at(hours=4), "running"), ("late done", at(hours=5), "done:0"),
]


@pytest.fixture()
def runs(spark):
    return spark.createDataFrame([(r, "p", "g", T0, h, m, True) for r, h, m in RUNS], S.RUNS)


def test_outcomes(spark, runs):
    polls = spark.createDataFrame(random.Random(1).sample(POLLS, len(POLLS)), S.RUN_POLLS)
    found = {r.run_id: r for r in telemetry.run_outcome(polls, runs).collect()}
    assert {k: r.outcome for k, r in found.items()} == {
        "spend": "max_spend", "done first": "success", "failed": "failed", "lost": "lost", "free": "running",
        "no limit": "running", "silent": "running", "late done": "max_spend", "no price": "running",
    }
    assert found["spend"].spent == 5.0 and found["spend"].elapsed_seconds == 9000.0
    assert found["failed"].exit_code == 3
    assert {k: r.pod_kept for k, r in found.items() if r.outcome != "running"} == {
        "spend": False, "done first": True, "failed": False, "lost": False, "late done": False,
    }
    kept = telemetry.run_outcome(polls, runs, keep_on_failure=True).filter("run_id = 'failed'").first()
    assert kept.pod_kept is True
    messages = {r.run_id: r.message for r in telemetry.spend_guard(polls, runs).collect()}
    assert messages == {
        "spend": "max spend reached ($5.00 >= $5.00)", "late done": "max spend reached ($8.00 >= $5.00)",
    }


def _outcome(polls, start, hourly, limit):
    """The poll loop, one run at a time."""
    for when, status in sorted(polls):
        if status.startswith("done:"):
            return "success" if int(status[5:]) == 0 else "failed"
        if status != "running":
            return "lost"
        if hourly > 0 and limit > 0 and (when - start).total_seconds() / 3600 * hourly >= limit:
            return "max_spend"
    return "running"


def test_outcomes_with_a_hot_run_equal_the_loop(spark):
    draw = random.Random(7)
    terms = {f"r{i}": (draw.choice([0.0, 0.5, 1.0]), draw.choice([0.0, 1.0, 40.0])) for i in range(60)}
    polls = []
    for i in range(4000):
        run = "r0" if i % 3 == 0 else f"r{draw.randrange(60)}"
        status = draw.choices(["running", "done:0", "done:2", "missing"], [400, 1, 1, 1])[0]
        polls.append((run, at(seconds=draw.randrange(10**6), microseconds=i), status))
    frame = spark.createDataFrame([(r, "p", "g", T0, *terms[r], False) for r in terms], S.RUNS)
    found = telemetry.run_outcome(spark.createDataFrame(polls, S.RUN_POLLS).repartition(9), frame)
    expected = {
        run: _outcome([p[1:] for p in polls if p[0] == run], T0, *terms[run]) for run in terms
    }
    assert {r.run_id: r.outcome for r in found.collect()} == expected
    assert len(set(expected.values())) > 3


def test_bucketed_tables_need_no_shuffle(spark, runs, tmp_path):
    polls = spark.createDataFrame(POLLS, S.RUN_POLLS)
    sinks.write_bucketed(polls, "polls_by_run", "run_id", 4, path=str(tmp_path / "polls"))
    sinks.write_bucketed(runs, "runs_by_run", "run_id", 4, path=str(tmp_path / "runs"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ended = telemetry.run_outcome(spark.table("polls_by_run"), spark.table("runs_by_run"), salts=1)
        plan = ended._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(tuple, ended.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE polls_by_run")
        spark.sql("DROP TABLE runs_by_run")
    assert "Exchange" not in plan
    assert found == sorted(map(tuple, telemetry.run_outcome(polls, runs).collect()))


def test_events(spark):
    frame = spark.createDataFrame(
        [("r", 2, "error", "b"), ("r", 1, "status", "a"), ("r", 3, "status", "c")], S.RUN_EVENTS
    )
    assert [r.message for r in telemetry.filter_events(frame).collect()] == ["a", "b", "c"]
    assert [r.message for r in telemetry.filter_events(frame, "error").collect()] == ["b"]


def test_launch_errors(spark):
    cases = {
        "not enough Balance": ("balance", []),
        "remote job failed with exit code 1": ("remote_job", []),
        "remote job failed with exit code 1, no funds": ("balance", []),
        "create pod: could not find any pods with required specifications": ("pod", []),
        'create network volume: X not found or does not support network volumes. Available data centers: A-1, B-2 ,C"':
            ("volume", ["A-1", "B-2", "C"]),
        "create network volume: nope": ("other", []),
        "Available data centers: A,　B. more": ("other", ["A", "B"]),
        "Available data centers:\n  X, Y\nZ.": ("other", []),
        "Available data centers:": ("other", [""]),
    }
    frame = spark.createDataFrame([(str(i), "runpod", m) for i, m in enumerate(cases)], S.LAUNCH_ERRORS)
    found = {r.message: (r.error_class, r.data_centers) for r in telemetry.classify_launch_errors(frame).collect()}
    import re

    for message, (kind, centers) in cases.items():
        match = re.search(r"Available data centers:\s*(.*?)(?:\"|\.|$)", message)
        expected = [d.strip() for d in match.group(1).split(",")] if match else []
        assert found[message] == (kind, expected), message
        assert centers == expected or "Z" in message


ENDPOINTS = [
    ("runpod", {"publicIp": "1.2.3.4", "portMappings": {"22": 40022}}, ("1.2.3.4", 40022)),
    ("runpod", {"publicIp": " 1.2.3.4 ", "portMappings": {"22": "40022"}}, ("1.2.3.4", 40022)),
    ("runpod", {"publicIp": "", "portMappings": {"22": 40022}}, None),
    ("runpod", {"publicIp": "1.2.3.4", "portMappings": {}}, None),
    ("runpod", {"publicIp": "1.2.3.4", "portMappings": None}, None),
    ("runpod", {"publicIp": "1.2.3.4", "portMappings": {"22": 0}}, None),
    ("primeintellect", {"sshConnection": "root@135.23.125.123 -p 2222"}, ("135.23.125.123", 2222)),
    ("primeintellect", {"sshConnection": ["ubuntu@gpu-77.example.com"]}, ("gpu-77.example.com", 22)),
    ("primeintellect", {"sshConnection": ["two words here", "h -p 9"]}, ("h", 9)),
    ("primeintellect", {"ip": "10.0.0.5", "primePortMapping": [
        {"usedBy": "WEB", "external": 1}, {"usedBy": "SSH", "external": 40002}]}, ("10.0.0.5", 40002)),
    ("primeintellect", {"ip": [" ", "10.0.0.6"], "primePortMapping": [{"usedBy": "SSH", "external": "x"}]}, ("10.0.0.6", 22)),
    ("primeintellect", {"ip": "10.0.0.7"}, ("10.0.0.7", 22)),
    ("primeintellect", {"sshConnection": None, "ip": None}, None),
    ("primeintellect", {}, None),
]


def test_endpoints(spark):
    frame = spark.createDataFrame([(i, p, json.dumps(d)) for i, (p, d, _) in enumerate(ENDPOINTS)], "i int, p string, j string")
    found = frame.select("i", L.ssh_endpoint(F.col("p"), F.try_parse_json("j")).alias("e")).orderBy("i").collect()
    for row, (_, document, expected) in zip(found, ENDPOINTS):
        assert (tuple(row.e) if row.e else None) == expected, document


def test_readiness(spark):
    up = {"desiredStatus": " running", "publicIp": "h", "portMappings": {"22": 5}}
    active = {"status": "ACTIVE", "sshConnection": "h -p 7"}
    rows = [
        ("ready", "runpod", 0, {"desiredStatus": "RUNNING"}), ("ready", "runpod", 60, up), ("ready", "runpod", 90, {"desiredStatus": "EXITED"}),
        ("failed", "runpod", 0, {"desiredStatus": "exited"}), ("failed", "runpod", 10, up),
        ("late", "runpod", 0, {}), ("late", "runpod", 1200, up),
        ("slow", "primeintellect", 0, {}), ("slow", "primeintellect", 1799, active),
        ("waiting", "primeintellect", 0, {"status": "ACTIVE"}), ("waiting", "primeintellect", 300, {"status": "PENDING"}),
        ("gone", "primeintellect", 0, {"status": "DELETING", "sshConnection": "h"}),
    ]
    frame = spark.createDataFrame([(p, v, at(seconds=s), json.dumps(d)) for p, v, s, d in rows], S.POD_SNAPSHOTS)
    found = {r.pod_id: (r.state, r.host, r.port) for r in telemetry.pod_readiness(frame).collect()}
    assert found == {
        "ready": ("ready", "h", 5), "failed": ("failed", None, None), "late": ("timeout", None, None),
        "slow": ("ready", "h", 7), "waiting": ("pending", None, None), "gone": ("failed", None, None),
    }


LOGS = [
    "\n".join(f"line {i}" for i in range(1, 26)),
    "\n".join(f"line {i}" for i in range(1, 21)),
    "  \n\n  first \n \t\nlast  \n\n \n",
    " \n\t\x1c\n",
    "",
    "\n".join(["x"] * 5 + ["", "  ", "", "y"] * 8 + ["z  "] + ["   "] * 40),
    "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k",
    "one",
]


def _tail(text):
    body = text.strip()
    if not body:
        return None
    parts = body.splitlines()
    if len(parts) > 20:
        return len(parts), True, "(... truncated ...)\n" + "\n".join(parts[-20:])
    return len(parts), False, body


def test_log_tails(spark):
    frame = spark.createDataFrame(
        [(str(i), "stdout", text) for i, text in enumerate(LOGS)] + [("0", "stderr", LOGS[0] + "\n")],
        "run_id string, stream string, text string",
    )
    expected = {str(i): _tail(text) for i, text in enumerate(LOGS) if _tail(text)}
    found = logs.log_tail(frame).collect()
    out = {r.run_id: (r.total_lines, r.truncated, r.message) for r in found if r.stream == "stdout"}
    assert out == expected
    error = next(r for r in found if r.stream == "stderr")
    assert error.message == LOGS[0] and error.kind == "error" and not error.truncated

    by_line = {
        r.run_id: (r.total_lines, r.truncated, r.message)
        for r in logs.stdout_tail(logs.split_lines(frame)).collect()
    }
    # Texts that need no cut keep their own line breaks; from lines they come joined anew.
    assert by_line == {k: (n, cut, "\n".join(m.splitlines())) for k, (n, cut, m) in expected.items()}


def test_failure_events(spark):
    texts = [("bad", "stdout", LOGS[0]), ("bad", "stderr", " oops\n"), ("good", "stdout", "x"), ("lost", "stderr", "y"),
             ("quiet", "stdout", " \n")]
    frame = spark.createDataFrame(texts, "run_id string, stream string, text string")
    ended = spark.createDataFrame(
        [("bad", "failed"), ("good", "success"), ("lost", "lost"), ("quiet", "failed")], "run_id string, outcome string"
    )
    found = {tuple(r) for r in logs.failure_events(frame, ended).collect()}
    assert found == {("bad", "output", _tail(LOGS[0])[2]), ("bad", "error", "oops")}


def test_line_breaks_agree_with_python(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k\n\nl"
    frame = spark.createDataFrame([("r", "stdout", text)], "run_id string, stream string, text string")
    assert [r.line for r in logs.split_lines(frame).orderBy("line_no").collect()] == text.splitlines()
    assert X.strip is not None and C.TAIL_LINES == 20


@pytest.mark.parametrize("block_lines", [3, 7, 100_000])
def test_log_entries(spark, block_lines):
    draw = random.Random(block_lines)
    rows, expected = [], {}
    for run in ("hot", "b", "c"):
        entry = stamp = None
        for number in range(1, 400 if run == "hot" else 40):
            if draw.random() < 0.1:
                entry, stamp = number, f"2024-01-01T00:{number % 60:02d}:00Z"
                line, message = f"[{stamp}] hello {number}  ", f"hello {number}"
            else:
                line = message = draw.choice(["  more", "", "[not a stamp] x", "[2024-01-01T00:00Z] y"])
            rows.append((run, "log", number, line))
            expected[(run, number)] = (entry, stamp, number - entry if entry else None, message)
    frame = spark.createDataFrame(rows, S.RUN_LOG_LINES).repartition(5)
    parsed = logs.parse_run_log(frame, block_lines)
    found = {(r.run_id, r.line_no): (r.entry_line, r.logged_at, r.part, r.message) for r in parsed.collect()}
    assert found == expected
    assert "SortAggregate" not in parsed._jdf.queryExecution().executedPlan().toString()


def test_streams_of_a_run_are_apart(spark):
    rows = [
        ("r", "stdout", 1, "[2024-01-01T00:00:01Z] out"), ("r", "stderr", 1, "plain"),
        ("r", "stdout", 2, "more"), ("r", "stderr", 2, "[2024-01-01T00:00:09Z] err"), ("r", "stderr", 3, "rest"),
    ]
    found = {
        (r.stream, r.line_no): (r.entry_line, r.logged_at)
        for r in logs.parse_run_log(spark.createDataFrame(rows, S.RUN_LOG_LINES), 2).collect()
    }
    assert found == {
        ("stdout", 1): (1, "2024-01-01T00:00:01Z"), ("stdout", 2): (1, "2024-01-01T00:00:01Z"),
        ("stderr", 1): (None, None), ("stderr", 2): (2, "2024-01-01T00:00:09Z"), ("stderr", 3): (2, "2024-01-01T00:00:09Z"),
    }


def test_entries_of_whole_texts(spark):
    text = "lost\n[2024-01-01T00:00:00Z] one  \n[2024-01-01T00:00:01Z] two\n  more\n\n[bad] x\n[2024-01-01T00:00:02Z] \n"
    frame = spark.createDataFrame([("r", "log", text), ("e", "log", "")], "run_id string, stream string, text string")
    found = [(r.run_id, r.entry, r.logged_at, r.message) for r in logs.log_entries(frame).collect()]
    assert found == [
        ("r", 1, None, "lost"),
        ("r", 2, "2024-01-01T00:00:00Z", "one"),
        ("r", 3, "2024-01-01T00:00:01Z", "two\n  more\n\n[bad] x"),
        ("r", 4, "2024-01-01T00:00:02Z", ""),
        ("e", 1, None, ""),
    ]
