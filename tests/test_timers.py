import json
import random
from datetime import datetime, timedelta

from slipway import schemas as S
from slipway.streaming import outcomes, timers

T0 = datetime(2024, 5, 1)
LIMITS = {"runpod": 1200, "primeintellect": 1800}
PENDING = {"runpod": {"desiredStatus": "RUNNING"}, "primeintellect": {"status": "PENDING"}}
READY = {
    "runpod": {"desiredStatus": "RUNNING", "publicIp": "10.0.0.1", "portMappings": {"22": 4022}},
    "primeintellect": {"status": "ACTIVE", "ip": ["10.0.0.2"]},
}
FAILED = {"runpod": {"desiredStatus": "EXITED"}, "primeintellect": {"status": "ERROR"}}


def _land(folder, rows, size):
    """Files of ``size`` rows in order of arrival; the first one comes twice."""
    folder.mkdir()
    parts = [rows[at : at + size] for at in range(0, len(rows), size)]
    for number, part in enumerate([*parts[:2], parts[0], *parts[2:]]):
        (folder / f"{number:03}.json").write_text("\n".join(json.dumps(row) for row in part))


def _read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def _settled(spark, tmp_path, stream):
    writer = outcomes.write_settled(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def _late_by(rows, draw, seconds):
    """Rows in an order in which none comes more than ``seconds`` after a later one."""
    return sorted(rows, key=lambda row: row[0] + draw.uniform(0, seconds))


def test_silent_pods_time_out_and_order_does_not_matter(spark, tmp_path):
    draw = random.Random(5)
    rows = []
    for number in range(24):
        provider = draw.choice(list(LIMITS))
        begin = draw.randrange(3000)
        for step in range(200 if number == 0 else draw.randrange(1, 7)):
            kind = draw.choices([PENDING, READY, FAILED], [12, 1, 1])[0]
            rows.append((begin + (step * 9 if number == 0 else draw.randrange(2200)), f"p{number}", provider, kind[provider]))
    rows.append((20_000, "clock", "runpod", PENDING["runpod"]))
    landed = [
        {"observed_ts": (T0 + timedelta(seconds=at)).isoformat() + "Z", "pod_id": pod, "provider": provider, "payload": json.dumps(payload)}
        for at, pod, provider, payload in _late_by(rows, draw, 500)
    ]
    _land(tmp_path / "in", landed, 90)
    expected = {}
    for pod in {row[1] for row in rows} - {"clock"}:
        mine = sorted((row for row in rows if row[1] == pod), key=lambda row: row[0])
        first, provider = mine[0][0], mine[0][2]
        end = first + LIMITS[provider]
        # Of equal times the state that sorts first decides, as in the batch operator.
        decided = sorted((at, "ready" if load is READY[provider] else "failed") for at, _, _, load in mine if load is not PENDING[provider])
        at, state = decided[0] if decided and decided[0][0] < end else (end, "timeout")
        expected[pod] = (state, T0 + timedelta(seconds=first), T0 + timedelta(seconds=at), state == "ready")
    stream = timers.readiness_decisions(_read(spark, tmp_path / "in", S.POD_SNAPSHOTS))
    found = _settled(spark, tmp_path, stream)
    assert len(found) == len(expected)
    assert {r.pod_id: (r.state, r.first_ts, r.decided_at, r.host is not None and r.port is not None) for r in found} == expected
    assert {state for state, *_ in expected.values()} == {"ready", "failed", "timeout"}


def test_spend_is_crossed_without_a_poll_and_withdrawn_by_an_end(spark, tmp_path):
    draw = random.Random(6)
    terms = {f"r{n}": (draw.choice([0.0, 1.0, 3.0]), draw.choice([0.0, 0.5, 1.0])) for n in range(40)}
    terms["hot"], terms["clock"] = (1.0, 1.0), (1.0, 1000.0)
    rows = [(at, "hot", "running") for at in range(0, 3000, 10)]
    for run in terms:
        if run not in ("hot", "clock"):
            for at in draw.sample(range(4500), draw.randrange(1, 6)):
                rows.append((at, run, draw.choices(["running", "done:0", "missing"], [5, 1, 1])[0]))
    rows += [(600, "edge", "done:0"), (9000, "clock", "running"), (9500, "hot", "running")]
    terms["edge"] = (3.0, 0.5)
    landed = [
        {"poll_ts": (T0 + timedelta(seconds=at)).isoformat() + "Z", "run_id": run, "raw_status": status}
        for at, run, status in _late_by(rows, draw, 500)
    ]
    _land(tmp_path / "in", landed, 90)
    expected = {}
    for run, (hourly, most) in terms.items():
        if hourly > 0 and most > 0 and run != "clock":
            crossed = most / hourly * 3600
            if not any(name == run and status != "running" and at <= crossed for at, name, status in rows):
                expected[run] = (T0 + timedelta(seconds=crossed), most)
    runs = spark.createDataFrame([(r, "p", "g", T0, *terms[r], False) for r in terms], S.RUNS)
    found = _settled(spark, tmp_path, timers.spend_crossings(_read(spark, tmp_path / "in", S.RUN_POLLS), runs))
    assert len(found) == len(expected) > 5 and "edge" not in expected and "hot" in expected
    assert {r.run_id: (r.crossed_at, r.spent) for r in found} == expected


def test_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("")
    assert _settled(spark, tmp_path, timers.readiness_decisions(_read(spark, tmp_path / "in", S.POD_SNAPSHOTS))) == []


def test_many_pods_share_few_states_that_are_dropped_in_the_end(spark, tmp_path):
    def snapshots(begin, pods):
        return [
            {"observed_ts": (T0 + timedelta(seconds=at)).isoformat() + "Z", "pod_id": pod, "provider": "runpod", "payload": json.dumps(payload)}
            for at, pod, payload in pods(begin)
        ]

    def many(begin):
        for number in range(2000):
            yield begin + number % 50, f"p{number}", (READY if number % 2 else PENDING)["runpod"]

    # The pods again after they are settled, as repeats, and a clock that lets all of them be forgotten.
    rows = snapshots(0, many), snapshots(4000, lambda at: [(at, "clock", PENDING["runpod"])]), snapshots(3900, many)
    rows += snapshots(20_000, lambda at: [(at, "clock", PENDING["runpod"])]), snapshots(40_000, lambda at: [(at, "last", PENDING["runpod"])])
    (tmp_path / "in").mkdir()
    for number, part in enumerate(rows):
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps(row) for row in part))
    stream = timers.readiness_decisions(_read(spark, tmp_path / "in", S.POD_SNAPSHOTS), forget_seconds=3600)
    query = outcomes.write_settled(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    waited = {r.pod_id: (r.state, (r.decided_at - r.first_ts).total_seconds()) for r in found}
    assert len(found) == len(waited) == 2001
    assert waited == {"clock": ("timeout", 1200)} | {f"p{n}": ("ready", 0) if n % 2 else ("timeout", 1200) for n in range(2000)}
    held = [progress.stateOperators[0].numRowsTotal for progress in query.recentProgress]
    assert 0 < max(held) <= timers.PARTS and held[-1] <= 2
