import json
import random
from datetime import datetime, timedelta

import pytest

from slipway import schemas as S
from slipway.operators import telemetry
from slipway.sources import landed
from slipway.streaming import outcomes

T0 = datetime(2024, 5, 1)


@pytest.fixture()
def case(spark, tmp_path):
    """Polls landed out of order in four files, one run holding a third of them."""
    draw = random.Random(23)
    terms = {f"r{i}": (draw.choice([0.0, 1.0]), draw.choice([0.0, 20.0])) for i in range(30)}
    polls = []
    for i in range(1200):
        run = "r0" if i % 3 == 0 else f"r{draw.randrange(30)}"
        status = draw.choices(["running", "done:0", "done:2", "missing"], [150, 1, 1, 1])[0]
        when = T0 + timedelta(seconds=draw.randrange(200_000), microseconds=i)
        polls.append((run, when, status))
    draw.shuffle(polls)
    folder = tmp_path / "polls"
    folder.mkdir()
    for part in range(4):
        lines = [
            json.dumps({"run_id": r, "poll_ts": w.isoformat() + "Z", "raw_status": s})
            for r, w, s in polls[part::4]
        ]
        (folder / f"{part}.json").write_text("\n".join(lines))
    runs = spark.createDataFrame([(r, "p", "g", T0, *terms[r], False) for r in terms], S.RUNS)
    batch = telemetry.run_outcome(landed.read_polls(spark, str(folder)), runs)
    expected = {r.run_id: (r.outcome, r.exit_code, r.elapsed_seconds, r.spent) for r in batch.collect()}
    assert len({e[0] for e in expected.values()}) >= 4
    return str(folder), runs, expected


def test_updates_end_as_the_batch_result(spark, tmp_path, case):
    folder, runs, expected = case
    polls = spark.readStream.schema("run_id string, poll_ts timestamp, raw_status string").option(
        "maxFilesPerTrigger", 1
    ).json(folder)
    out = str(tmp_path / "out")
    writer = outcomes.write_decisions(outcomes.decisions(polls, runs), out, str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 4
    found = outcomes.read_outcomes(spark, out, runs).collect()
    assert {r.run_id: (r.outcome, r.exit_code, r.elapsed_seconds, r.spent) for r in found} == expected


def test_a_repeated_batch_changes_nothing(spark, tmp_path, case):
    folder, runs, expected = case
    out = str(tmp_path / "out")
    for attempt in range(2):
        polls = landed.read_polls(spark, folder, stream=True)
        writer = outcomes.write_decisions(outcomes.decisions(polls, runs), out, str(tmp_path / f"state{attempt}"))
        writer.trigger(availableNow=True).start().awaitTermination()
    found = outcomes.read_outcomes(spark, out, runs).collect()
    assert {r.run_id: r.outcome for r in found} == {k: v[0] for k, v in expected.items()}


def test_settled_decisions_end_as_the_batch_result(spark, tmp_path, case):
    folder, runs, expected = case
    out, state = str(tmp_path / "settled"), str(tmp_path / "state")

    def drain():
        polls = landed.read_polls(spark, folder, stream=True)
        settled = outcomes.settled_decisions(polls, runs, lateness="10 days")
        outcomes.write_settled(settled, out, state).trigger(availableNow=True).start().awaitTermination()

    drain()
    # A far poll pushes the watermark past all windows; the next batch lets them out.
    for month in (7, 8):
        far = {"run_id": "nobody", "poll_ts": f"2024-{month:02d}-01T00:00:00Z", "raw_status": "running"}
        (tmp_path / "polls" / f"far{month}.json").write_text(json.dumps(far))
        drain()
    found = outcomes.read_outcomes(spark, out, runs).collect()
    assert {r.run_id: (r.outcome, r.exit_code, r.elapsed_seconds, r.spent) for r in found} == expected


def test_spend_alerts(spark, case):
    folder, runs, expected = case
    polls = landed.read_polls(spark, folder)
    alerts = outcomes.spend_alerts(outcomes.decisions(polls, runs)).collect()
    assert {r.run_id for r in alerts} == {k for k, v in expected.items() if v[0] == "max_spend"}
