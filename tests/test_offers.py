import random

import pytest
from pyspark.sql import functions as F

from slipway import schemas as S
from slipway.constants import GPU_CATALOG
from slipway.functions import pricing as P
from slipway.operators import offers as O

REQUESTS = [
    ("a", 80, 2.0, "SECURE", 1),
    ("b", 48, 2.0, "SECURE", 1),
    ("c", 24, 1.0, "SECURE", 1),
    ("d", 24, 1.0, "SECURE", 4),
    ("e", 100000, None, "SECURE", 1),
    ("f", 94, None, "community", 1),
    ("g", 94, 0.0, "ALL", 0),
]


def test_candidates(spark):
    found = O.gpu_type_ids(spark.createDataFrame(REQUESTS, S.RUN_REQUESTS))
    ids = {r.run_id: r.gpu_type_ids for r in found.collect()}
    assert ids["a"] == ["NVIDIA A100 80GB PCIe", "NVIDIA A100-SXM4-80GB"]
    assert ids["b"] == [
        "NVIDIA A40", "NVIDIA L40", "NVIDIA L40S", "NVIDIA RTX 6000 Ada Generation",
        "NVIDIA A100 80GB PCIe", "NVIDIA A100-SXM4-80GB",
    ]
    assert ids["c"] == ["NVIDIA GeForce RTX 3090"]
    assert ids["d"] == [] and ids["e"] == []
    assert ids["f"][0] == "NVIDIA H100 NVL"
    assert len(ids["g"]) == 5
    hourly = {r.run_id: r.estimated_hourly_dollars for r in found.collect()}
    assert hourly["f"] == 2.69 and hourly["e"] is None and hourly["g"] == 4.0


def test_candidates_do_not_depend_on_catalog_order(spark):
    frame = spark.createDataFrame(REQUESTS, S.RUN_REQUESTS)
    expected = sorted(map(tuple, O.candidate_gpus(frame).collect()), key=str)
    shuffled = list(GPU_CATALOG)
    random.Random(3).shuffle(shuffled)
    assert sorted(map(tuple, O.candidate_gpus(frame, shuffled).collect()), key=str) == expected


def test_pod_price_doubles_with_gpus(spark):
    frame = spark.createDataFrame(
        [("one", 80, None, "SECURE", 1), ("two", 80, None, "SECURE", 2)], S.RUN_REQUESTS
    )
    found = {r.run_id: r.estimated_hourly_dollars for r in O.gpu_type_ids(frame).collect()}
    assert found["two"] == 2 * found["one"]


def test_cheapest_fit_against_brute_force(spark):
    needs = spark.range(0, 210).select(F.col("id").alias("need"))
    for cloud, community in (("COMMUNITY", True), ("secure", False)):
        found = needs.select("need", P.cheapest_fit(F.col("need"), F.lit(cloud), GPU_CATALOG).alias("f")).collect()
        for row in found:
            fits = [g for g in GPU_CATALOG if g.memory_gb >= row.need]
            best = min(fits, key=lambda g: (P.hourly(g, community), g.memory_gb, g.gpu_id), default=None)
            assert (row.f.gpu_id if row.f else None) == (best.gpu_id if best else None)


def test_estimated_hourly(spark):
    frame = spark.createDataFrame([("NVIDIA L4", "community"), ("NVIDIA L4", "x"), ("no", "x")], "gpu_id string, cloud_type string")
    assert [r.estimated_hourly for r in O.estimated_hourly(frame).collect()] == [0.40, 1.10, None]
    billed = O.estimated_hourly(frame, planned_hourly=F.lit(7.0)).collect()
    assert [r.billed_hourly for r in billed] == [0.40, 1.10, 7.0]
    unplanned = O.estimated_hourly(frame, planned_hourly=F.lit(None).cast("double")).collect()
    assert [r.billed_hourly for r in unplanned] == [0.40, 1.10, 0.0]


def offer(cloud="n3-A100x1", kind="A100_80GB", memory=80.0, price=1.5, **changes):
    row = dict(
        cloud_id=cloud, gpu_type=kind, socket="SXM4", provider="hyperstack", security="secure_cloud",
        data_center=None, region=None, country=None, gpu_memory=memory, gpu_count=1,
        stock_status="High", is_spot=False, price_on_demand=price, price_community=None,
        images=["ubuntu_22_cuda_12", "cuda_12_4_pytorch_2_5"], disk_min_gb=40.0, disk_max_gb=500.0,
    )
    row.update(changes)
    return tuple(row[name] for name in S.GPU_OFFERS.fieldNames())


MARKET = [
    offer(kind="H100_80GB", price=2.5),
    offer(),
    offer(kind="L4", memory=24.0, price=0.3),
    offer(kind="B200", memory=180.0, price=9.0),
    offer(kind="H100_80GB", price=0.9, is_spot=True),
    offer(kind="H100_80GB", price=0.9, stock_status="Unavailable"),
    offer(kind="H200", memory=141.0, price=None),
]


def test_list_offers(spark):
    frame = spark.createDataFrame(MARKET, S.GPU_OFFERS)
    listed = O.list_offers(frame, min_vram_gb=48, max_dollars_per_hour=5.0, cloud_type="SECURE").collect()
    assert [r.gpu_type for r in listed] == ["A100_80GB", "H100_80GB"]
    assert listed[0].label == "A100_80GB (hyperstack/n3-A100x1)" and listed[0].hourly == 1.5


def test_top_offers_share_the_pod_cap(spark):
    frame = spark.createDataFrame([offer(gpu_count=4, price=2.0), offer(gpu_count=4, price=3.5, cloud="x")], S.GPU_OFFERS)
    asked = spark.createDataFrame([("r", 48, 12.0, "SECURE", 4)], S.RUN_REQUESTS)
    found = O.top_offers(asked, frame).first()
    assert found.offer_labels == ["A100_80GB (hyperstack/n3-A100x1)"]
    assert found.estimated_hourly_dollars == 8.0


def test_pod_price_quote_wins(spark):
    frame = spark.createDataFrame([(2.0, 4, 7.5), (2.0, 4, None), (None, 0, -1.0)], "p double, n int, q double")
    prices = frame.select(P.pod_hourly(F.col("p"), F.col("n"), F.col("q"))).collect()
    assert [r[0] for r in prices] == [7.5, 8.0, 0.0]


def _brute(requests, market, k):
    result = {}
    names = S.GPU_OFFERS.fieldNames()
    for run_id, floor, cap, cloud, count in requests:
        count = max(1, count)
        if cap is not None and cap > 0:
            cap = cap / count
        scope = {"COMMUNITY": "community_cloud", "ALL": None}.get(cloud.strip().upper(), "secure_cloud")
        kept = []
        for row in market:
            o = dict(zip(names, row))
            prices = [p for p in (o["price_on_demand"], o["price_community"]) if p and p > 0]
            if o["is_spot"] or (o["stock_status"] or "").lower() == "unavailable" or not prices:
                continue
            if o["gpu_count"] != count or (scope and o["security"] != scope) or o["gpu_memory"] < floor:
                continue
            if cap is not None and cap > 0 and prices[0] > cap:
                continue
            label = "%s (%s/%s)" % tuple("?" if o[n] is None else o[n] for n in ("gpu_type", "provider", "cloud_id"))
            kept.append((o["gpu_memory"], prices[0], label))
        result[run_id] = sorted(kept)[:k]
    return result


def _random_market(size):
    draw = random.Random(11)
    market = [
        offer(
            cloud=f"c{draw.randrange(40)}", kind=draw.choice(["A", "B", None]),
            # Fractions of a GB, and one level that holds a third of all offers.
            memory=80.0 if draw.random() < 0.34 else draw.choice([24.0, 24.5, 48.0, 79.5, 80.25, 141.0]),
            price=draw.choice([None, 0.0, -1.0, 0.5, 1.0, 1.5, 2.0, 2.5]),
            price_community=draw.choice([None, 1.25]),
            security=draw.choice(["secure_cloud", "community_cloud", None]),
            gpu_count=draw.choice([1, 2]), is_spot=draw.choice([True, False, False, None]),
            stock_status=draw.choice(["High", None, "UNAVAILABLE"]),
        )
        for _ in range(size)
    ]
    requests = [
        (f"r{i}", draw.choice([0, 24, 25, 48, 80, 81, 200]), draw.choice([None, 0.0, 0.5, 1.0, 2.0, 3.0]),
         draw.choice([" community", "SECURE", "all", ""]), draw.choice([0, 1, 2, 3]))
        for i in range(120)
    ]
    return market, requests


@pytest.mark.parametrize("k", [1, 8, 300])
def test_top_offers_against_brute_force(spark, k):
    market, requests = _random_market(600)
    found = O.top_offers(
        spark.createDataFrame(requests, S.RUN_REQUESTS),
        spark.createDataFrame(market, S.GPU_OFFERS).repartition(7),
        k,
    )
    got = {r.run_id: [tuple(o) for o in r.offers] for r in found.collect()}
    assert got == _brute(requests, market, k)
    assert k < 300 or max(map(len, got.values())) > 100


def test_matching_runs_no_job_while_the_query_is_built(spark):
    market, requests = _random_market(50)
    frames = spark.createDataFrame(requests, S.RUN_REQUESTS), spark.createDataFrame(market, S.GPU_OFFERS)
    spark.sparkContext.setJobGroup("building", "")
    found = O.top_offers(*frames)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("other", "")
    assert found.count() == len(requests)


def test_a_quoted_price_wins(spark):
    quoted = spark.createDataFrame([("r", 48, None, "SECURE", 4, 5.5), ("s", 48, None, "SECURE", 4, None)],
                                   "run_id string, vram_gb int, max_dollars_per_hour double, cloud_type string, "
                                   "gpu_count int, quoted_hourly double")
    market = spark.createDataFrame([offer(gpu_count=4, price=2.0)], S.GPU_OFFERS)
    assert {r.run_id: r.estimated_hourly_dollars for r in O.top_offers(quoted, market).collect()} == {"r": 5.5, "s": 8.0}
    priced = O.price_offers(market.withColumn("quoted_hourly", F.lit(7.0)))
    assert priced.first().pod_hourly == 7.0


def test_requests_may_share_their_id(spark):
    asked = spark.createDataFrame([("r", 48, None, "SECURE", 1), ("r", 48, 2.0, "SECURE", 1), ("r", 48, 2.0, "SECURE", 1)], S.RUN_REQUESTS)
    found = O.top_offers(asked, spark.createDataFrame(MARKET, S.GPU_OFFERS))
    assert sorted(len(r.offers) for r in found.collect()) == [1, 1, 3]


def test_images(spark):
    frame = spark.createDataFrame(
        [offer(), offer(images=None), offer(images=["x", "y"]), offer(images=[])], S.GPU_OFFERS
    )
    docker = [r.image for r in O.select_image(frame, "runpod/pytorch:2.8.0-py3.11").collect()]
    assert docker == ["cuda_12_4_pytorch_2_5", "cuda_12_6_pytorch_2_7", "x", "cuda_12_6_pytorch_2_7"]
    assert {r.image for r in O.select_image(frame, " ubuntu_26 ").collect()} == {"ubuntu_26"}


def test_disk_is_clamped(spark):
    frame = spark.createDataFrame(
        [offer(), offer(disk_min_gb=None, disk_max_gb=0.5), offer(disk_min_gb=None, disk_max_gb=None)], S.GPU_OFFERS
    )
    odd = spark.createDataFrame([offer(disk_min_gb=1e300, disk_max_gb=float("nan"))], S.GPU_OFFERS)
    assert O.clamp_disk(odd, 7).first().disk_gb == 7
    found = {n: [r.disk_gb for r in O.clamp_disk(frame, n).collect()] for n in (120, 10, 900)}
    assert found == {120: [120, None, 120], 10: [40, None, 10], 900: [500, None, 900]}


def test_pins(spark):
    frame = spark.createDataFrame([(["a", "b", "c"],), (["c"],), ([],)], "gpu_type_ids array<string>")
    assert [r[0] for r in O.pin_gpus(frame, "b, ,a").collect()] == [["a", "b"], ["c"], []]
    assert [r[0] for r in O.pin_gpus(frame, "").collect()] == [["a", "b", "c"], ["c"], []]
