"""Requests matched against the price list and against tables of marketplace offers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.constants import GPU_CATALOG, GpuType
from slipway.functions import pricing as P
from slipway.functions.joins import SALTS, lookup_join, salt_of, top_k


def _fits(floor: Column, cap: Column, cloud_type: Column, catalog: Sequence[GpuType]) -> Column:
    """Candidates of one request as an array in rank order."""

    def keep(offer: Column) -> Column:
        return (offer["memory_gb"] >= floor) & P.within_cap(offer["hourly"], cap)

    return P.price_for_cloud(
        cloud_type,
        F.filter(P.ranked_catalog(catalog, True), keep),
        F.filter(P.ranked_catalog(catalog, False), keep),
    )


def candidate_gpus(requests: DataFrame, catalog: Sequence[GpuType] = GPU_CATALOG) -> DataFrame:
    """One row per request and GPU type that meets its memory floor and hourly cap.

    ``requests`` has vram_gb, max_dollars_per_hour (per GPU) and cloud_type. The price list
    is sorted while the plan is built and each request filters it in place, so ranking
    needs neither a join nor a shuffle. Smallest memory first, then price, then id.
    """
    fits = _fits(
        F.col("vram_gb"),
        F.col("max_dollars_per_hour"),
        F.col("cloud_type"),
        P.checked_catalog(catalog),
    )
    return requests.select("*", F.posexplode(fits).alias("_pos", "_gpu")).select(
        *requests.columns,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_gpu.gpu_id"),
        F.col("_gpu.memory_gb"),
        F.col("_gpu.hourly"),
    )


def gpu_type_ids(requests: DataFrame, catalog: Sequence[GpuType] = GPU_CATALOG) -> DataFrame:
    """Each request with its ranked candidate ids, best hourly price of the pod and caps.

    ``max_dollars_per_hour`` is the cap of the whole pod here; it is spread over the GPUs.
    """
    entries = P.checked_catalog(catalog)
    cap = P.per_gpu_cap(F.col("max_dollars_per_hour"), F.col("gpu_count"))
    fits = _fits(F.col("vram_gb"), cap, F.col("cloud_type"), entries)
    return (
        requests.withColumn("_fits", fits)
        .withColumn("gpu_type_ids", F.transform(F.col("_fits"), lambda gpu: gpu["gpu_id"]))
        .withColumn(
            "estimated_hourly_dollars",
            F.get(F.col("_fits"), F.lit(0))["hourly"] * F.greatest(F.lit(1), F.col("gpu_count")),
        )
        .drop("_fits")
    )


def estimated_hourly(
    gpus: DataFrame,
    catalog: Sequence[GpuType] = GPU_CATALOG,
    *,
    planned_hourly: Column | None = None,
) -> DataFrame:
    """Catalogue price for rows with gpu_id and cloud_type; null for an unknown id.

    With ``planned_hourly`` also the rate a run is billed at: the catalogue price, else the
    planned one, else 0.
    """
    price = P.estimated_hourly(F.col("gpu_id"), F.col("cloud_type"), P.checked_catalog(catalog))
    priced = gpus.withColumn("estimated_hourly", price)
    if planned_hourly is None:
        return priced
    return priced.withColumn(
        "billed_hourly", P.billed_hourly(F.col("estimated_hourly"), planned_hourly)
    )


def price_offers(offers: DataFrame) -> DataFrame:
    """``offers`` with label, price per GPU and price of the whole pod; null if unpriced.

    A positive ``quoted_hourly``, where the table has that column, is the price of the pod.
    """
    priced = offers.select(
        "*",
        P.offer_hourly(F.col("price_on_demand"), F.col("price_community")).alias("hourly"),
        P.offer_label(F.col("gpu_type"), F.col("provider"), F.col("cloud_id")).alias("label"),
    )
    quote = F.col("quoted_hourly") if "quoted_hourly" in offers.columns else F.lit(None).cast("double")
    whole = P.pod_hourly(F.col("hourly"), F.col("gpu_count"), quote)
    return priced.withColumn("pod_hourly", F.when(F.col("hourly").isNotNull(), whole))


def rentable_offers(offers: DataFrame) -> DataFrame:
    """Priced offers that are on demand and in stock."""
    stock = F.lower(F.coalesce(F.col("stock_status"), F.lit("")))
    return price_offers(offers).filter(
        ~F.coalesce(F.col("is_spot"), F.lit(False))
        & (stock != "unavailable")
        & F.col("gpu_memory").isNotNull()
        & F.col("hourly").isNotNull()
    )


def list_offers(
    offers: DataFrame,
    *,
    min_vram_gb: int,
    max_dollars_per_hour: float | None,
    cloud_type: str,
    gpu_count: int = 1,
) -> DataFrame:
    """All offers for one request, sorted by memory, price and label."""
    scope = P.security_scope(F.lit(cloud_type))
    return (
        rentable_offers(offers)
        .filter(
            (F.col("gpu_count") == gpu_count)
            & ((scope == P.ANY_SECURITY) | (F.col("security") == scope))
            & (F.col("gpu_memory") >= min_vram_gb)
            & P.within_cap(F.col("hourly"), F.lit(max_dollars_per_hour).cast("double"))
        )
        .orderBy("gpu_memory", "hourly", "label")
    )


def _price_levels(offers: DataFrame, k: int) -> DataFrame:
    """Per (GPU count, security scope, memory) the ``k`` cheapest offers as a sorted array.

    A request takes whole memory levels in order and, of each, the offers up to its cap,
    which is a prefix of that level by price. So no offer past the ``k``-th of its level
    can be among the first ``k`` of any request, and dropping those loses nothing.
    """
    scoped = rentable_offers(offers).select(
        F.col("gpu_count").alias("_gpus"),
        F.explode(F.array_distinct(F.array(F.lit(P.ANY_SECURITY), F.col("security")))).alias("_scope"),
        "gpu_memory",
        "hourly",
        "label",
    )
    level = ["_gpus", "_scope", "gpu_memory"]
    best = top_k(
        scoped.filter(F.col("_scope").isNotNull()),
        level,
        [F.col("hourly"), F.col("label")],
        k,
        salt_by=["label", "hourly"],
    )
    return best.groupBy(*level).agg(
        F.sort_array(F.collect_list(F.struct("hourly", "label"))).alias("offers")
    )


def top_offers(
    requests: DataFrame,
    offers: DataFrame,
    k: int = C.OFFERS_PER_PLAN,
    *,
    key: str = "run_id",
    only: Column | None = None,
) -> DataFrame:
    """Each request with its first ``k`` offers: labels, pod price and the offers as array.

    Offers are cut to the ``k`` cheapest per memory level before requests see them. Requests
    that ask for the same are matched once, as one demand: it meets the levels of its GPU
    count and security scope, cut to their affordable prefixes, and keeps the first ``k``
    offers of the lowest levels. The result goes back to the requests in a salted lookup,
    spread by ``key``. It is one lazy plan, whatever the sizes. Requests that fail ``only``
    get no offers. The cap is that of the whole pod.
    """
    scope = P.security_scope(F.col("cloud_type"))
    cap = P.per_gpu_cap(F.col("max_dollars_per_hour"), F.col("gpu_count"))
    asked = requests.select(
        *requests.columns,
        F.greatest(F.lit(1), F.col("gpu_count")).alias("_gpus"),
        (scope if only is None else F.when(only, scope)).alias("_scope"),
        F.when(cap > 0, cap).otherwise(F.lit(-1.0)).alias("_limit"),
        F.col("vram_gb").alias("_floor"),
    )
    demand = ["_gpus", "_scope", "_floor", "_limit"]
    demands = asked.filter(F.col("_scope").isNotNull()).select(*demand).distinct()
    spread = _price_levels(offers, k).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    affordable = F.filter(
        F.col("offers"), lambda offer: (F.col("_limit") < 0) | (offer["hourly"] <= F.col("_limit"))
    )
    pairs = (
        demands.withColumn("_salt", salt_of(*(F.col(name) for name in demand)))
        .join(spread, ["_gpus", "_scope", "_salt"])
        .filter(F.col("gpu_memory") >= F.col("_floor"))
        .select(*demand, "gpu_memory", F.explode(affordable).alias("offer"))
        .select(*demand, "gpu_memory", "offer.hourly", "offer.label")
    )
    order = [F.col("gpu_memory"), F.col("hourly"), F.col("label")]
    found = top_k(pairs, demand, order, k).groupBy(*demand).agg(
        F.sort_array(F.collect_list(F.struct("gpu_memory", "hourly", "label"))).alias("offers")
    )
    matched = lookup_join(asked, found, demand, [key])
    none = F.array().cast("array<struct<gpu_memory:double,hourly:double,label:string>>")
    first = F.get(F.col("offers"), F.lit(0))
    quote = F.col("quoted_hourly") if "quoted_hourly" in requests.columns else F.lit(None).cast("double")
    return matched.select(
        *requests.columns,
        F.coalesce(F.col("offers"), none).alias("offers"),
    ).select(
        "*",
        F.transform(F.col("offers"), lambda offer: offer["label"]).alias("offer_labels"),
        F.when(F.size("offers") > 0, P.pod_hourly(first["hourly"], F.col("gpu_count"), quote)).alias(
            "estimated_hourly_dollars"
        ),
    )


def select_image(offers: DataFrame, image: str | Column) -> DataFrame:
    """``offers`` plus the image each of them would start."""
    asked = F.lit(image) if isinstance(image, str) else image
    return offers.withColumn("image", P.select_image(asked, F.col("images")))


def clamp_disk(offers: DataFrame, requested_gb: int | Column) -> DataFrame:
    """``offers`` plus the disk size each of them would give to the request."""
    asked = requested_gb if isinstance(requested_gb, Column) else F.lit(requested_gb)
    size = P.clamp_disk(asked, F.col("disk_min_gb"), F.col("disk_max_gb"))
    return offers.withColumn("disk_gb", size)


def pin_gpus(plans: DataFrame, pinned: Sequence[str] | str) -> DataFrame:
    """``plans`` with gpu_type_ids cut to the pinned ones, unless that leaves none."""
    return plans.withColumn("gpu_type_ids", P.pin_gpus(F.col("gpu_type_ids"), pinned))
