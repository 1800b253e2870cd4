"""Rules for prices, labels, images and disks of GPU offers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.constants import GpuType
from slipway.functions.text import strip


def is_community(cloud_type: Column) -> Column:
    return F.coalesce(F.upper(cloud_type) == "COMMUNITY", F.lit(False))


def price_for_cloud(cloud_type: Column, community: Column, secure: Column) -> Column:
    """What holds for community offers if the cloud is COMMUNITY in any case, else the other."""
    return F.when(is_community(cloud_type), community).otherwise(secure)


def per_gpu_cap(max_dollars_per_hour: Column, gpu_count: Column) -> Column:
    """The pod's hourly cap spread over its GPUs; null or <= 0 means no cap and stays as is."""
    return F.when(
        max_dollars_per_hour > 0, max_dollars_per_hour / F.greatest(F.lit(1), gpu_count)
    ).otherwise(max_dollars_per_hour)


def within_cap(price: Column, cap: Column) -> Column:
    return F.coalesce(~(cap > 0) | (price <= cap), F.lit(True))


def offer_hourly(price_on_demand: Column, price_community: Column) -> Column:
    return F.coalesce(
        F.when(price_on_demand > 0, price_on_demand),
        F.when(price_community > 0, price_community),
    )


def offer_label(gpu_type: Column, provider: Column, cloud_id: Column) -> Column:
    def known(value: Column) -> Column:
        return F.coalesce(value, F.lit("?"))

    return F.concat(
        known(gpu_type), F.lit(" ("), known(provider), F.lit("/"), known(cloud_id), F.lit(")")
    )


ANY_SECURITY = "any"


def security_scope(cloud_type: Column) -> Column:
    """Which offers a request may use: one security tier, or any of them."""
    cloud = F.upper(strip(F.coalesce(cloud_type, F.lit(""))))
    return (
        F.when(cloud == "COMMUNITY", F.lit("community_cloud"))
        .when(cloud == "ALL", F.lit(ANY_SECURITY))
        .otherwise(F.lit("secure_cloud"))
    )


def pod_hourly(per_gpu_price: Column, gpu_count: Column, quoted: Column) -> Column:
    """Whole-pod price: the provider's quote when positive, else the per-GPU price times n."""
    return F.when(quoted > 0, quoted).otherwise(
        F.coalesce(per_gpu_price, F.lit(0.0)) * F.greatest(F.lit(1), gpu_count)
    )


def select_image(image: Column, images: Column) -> Column:
    """The asked image unless it is a docker tag; then the best one the offer has."""
    asked = strip(F.coalesce(image, F.lit("")))
    offered = F.coalesce(images, F.array().cast("array<string>"))
    preferred = F.array(*[F.lit(name) for name in C.PREFERRED_IMAGES])
    plain = (asked != "") & ~F.contains(asked, F.lit("/")) & ~F.contains(asked, F.lit(":"))
    return F.when(plain, asked).otherwise(
        F.coalesce(
            F.get(F.array_intersect(preferred, offered), F.lit(0)),
            F.get(offered, F.lit(0)),
            F.lit(C.PREFERRED_IMAGES[0]),
        )
    )


def clamp_disk(requested_gb: Column, disk_min_gb: Column, disk_max_gb: Column) -> Column:
    """The request raised to the offer's minimum, then cut to its maximum; null if <= 0.

    A limit that is no number, or beyond any disk, does not count.
    """
    raised = F.greatest(requested_gb.cast("bigint"), disk_min_gb.try_cast("bigint"))
    size = F.least(raised, disk_max_gb.try_cast("bigint"))
    return F.when(requested_gb.isNotNull() & (size > 0), size)


def pin_gpus(gpu_type_ids: Column, pinned: Sequence[str] | str) -> Column:
    """Only the pinned ids, in rank order; every id when no pinned one is a candidate."""
    if isinstance(pinned, str):
        pinned = pinned.split(",")
    names = [name.strip() for name in pinned if name.strip()]
    if not names:
        return gpu_type_ids
    kept = F.filter(gpu_type_ids, lambda gpu: gpu.isin(*names))
    return F.when(F.size(kept) > 0, kept).otherwise(gpu_type_ids)


def checked_catalog(catalog: Sequence[GpuType]) -> tuple[GpuType, ...]:
    """The catalogue as named rows; it is a literal of the plan, whatever its length."""
    return tuple(GpuType(*row) for row in catalog)


def hourly(gpu: GpuType, community: bool) -> float:
    return gpu.community_dollars_per_hour if community else gpu.secure_dollars_per_hour


def ranked_catalog(catalog: Sequence[GpuType], community: bool) -> Column:
    """Literal array of the catalogue in candidate order: memory, price, id."""
    order = sorted(catalog, key=lambda gpu: (gpu.memory_gb, hourly(gpu, community), gpu.gpu_id))
    return F.array(
        *(
            F.struct(
                F.lit(gpu.gpu_id).alias("gpu_id"),
                F.lit(gpu.memory_gb).alias("memory_gb"),
                F.lit(hourly(gpu, community)).alias("hourly"),
            )
            for gpu in order
        )
    )


def estimated_hourly(gpu_id: Column, cloud_type: Column, catalog: Sequence[GpuType]) -> Column:
    """Catalogue price of a GPU id, null when the id is unknown."""

    def price(community: bool) -> Column:
        pairs = [part for gpu in catalog for part in (F.lit(gpu.gpu_id), F.lit(hourly(gpu, community)))]
        return F.try_element_at(F.create_map(*pairs), gpu_id)

    return price_for_cloud(cloud_type, price(True), price(False))


def billed_hourly(catalog_hourly: Column, planned_hourly: Column) -> Column:
    """The first of the two rates that is known and not 0, else 0."""
    return F.coalesce(
        F.nullif(catalog_hourly, F.lit(0.0)), F.nullif(planned_hourly, F.lit(0.0)), F.lit(0.0)
    )


def cheapest_fit(need_gb: Column, cloud_type: Column, catalog: Sequence[GpuType]) -> Column:
    """Struct (gpu_id, hourly) of the cheapest GPU with enough memory, null if none has.

    Walks the price list upwards, so the first entry that fits is the cheapest; entries
    no larger than a cheaper one can never be reached and are left out.
    """

    def ladder(community: bool) -> Column:
        steps: Column | None = None
        largest = None
        for gpu in sorted(catalog, key=lambda g: (hourly(g, community), g.memory_gb, g.gpu_id)):
            if largest is not None and gpu.memory_gb <= largest:
                continue
            largest = gpu.memory_gb
            choice = F.struct(
                F.lit(gpu.gpu_id).alias("gpu_id"), F.lit(hourly(gpu, community)).alias("hourly")
            )
            fits = need_gb <= gpu.memory_gb
            steps = F.when(fits, choice) if steps is None else steps.when(fits, choice)
        if steps is None:
            return F.lit(None).cast("struct<gpu_id:string,hourly:double>")
        return steps

    return price_for_cloud(cloud_type, ladder(True), ladder(False))
