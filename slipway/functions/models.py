"""Rules for model weights, architectures and memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.functions.numbers import exact_product


def gib(value: Column) -> Column:
    return value / F.lit(float(C.GIB))


def is_weight_file(name: Column) -> Column:
    """Whether a file name in lower case is that of a weight file."""
    suffix = F.endswith(name, F.lit(C.WEIGHT_SUFFIXES[0]))
    for other in C.WEIGHT_SUFFIXES[1:]:
        suffix = suffix | F.endswith(name, F.lit(other))
    return suffix & ~F.contains(name, F.lit(C.NOT_WEIGHTS_MARKER))


def weight_file_bytes(name: Column, size_bytes: Column) -> Column:
    """Bytes this file adds to its model: 0 unless it is a weight file of positive size."""
    return F.when((size_bytes > 0) & is_weight_file(name), size_bytes).otherwise(F.lit(0))


def half_bytes_per_param(tag: Column) -> Column:
    """Storage width of an upper-case dtype tag in half bytes, so that 4-bit types stay whole."""
    other = C.DEFAULT_DTYPE_BYTES
    width = F.lit(int(2 * other))
    for size in sorted({size for size in C.DTYPE_BYTES.values() if size != other}):
        tags = [name for name, bytes_each in C.DTYPE_BYTES.items() if bytes_each == size]
        width = F.when(tag.isin(*tags), F.lit(int(2 * size))).otherwise(width)
    return width.cast("bigint")


def suggest_volume_gb(
    size_gb: Column,
    multiplier: float = C.VOLUME_MULTIPLIER,
    minimum: int = C.VOLUME_MINIMUM_GB,
    fallback: int | Column = C.VOLUME_FALLBACK_GB,
) -> Column:
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    wanted = F.coalesce(F.ceil(size_gb * F.lit(float(multiplier))), fallback.cast("bigint"))
    return F.greatest(F.lit(minimum).cast("bigint"), wanted)


def variant_number(value: Column) -> Column:
    """A VARIANT as a 64-bit number, whatever its type; null if it cannot be one."""
    return F.try_variant_get(value, "$", "bigint")


def positive_int(value: Column, number: Column) -> Column:
    """``number``, read from the VARIANT ``value``, if that is a JSON integer above zero.

    ``true`` counts as 1, as it does in Python; 4096.0 and "4096" do not count. The type is
    looked at only where a number came out.
    """
    return F.when((number > 0) & F.schema_of_variant(value).isin("BIGINT", "BOOLEAN"), number)


def config_entry(document: Column, text_config: Column, key: str) -> Column:
    """The value (a VARIANT) a config document gives to ``key``.

    A key present in ``text_config`` hides the top-level one, whatever it holds: a JSON null
    is a value here, and only a missing key is null.
    """
    nested = F.when(text_config.isNotNull(), F.try_variant_get(text_config, f"$.{key}", "variant"))
    return F.coalesce(nested, F.try_variant_get(document, f"$.{key}", "variant"))


def kv_heads_or_attention(kv_heads: Column, attention_heads: Column) -> Column:
    return F.coalesce(kv_heads, attention_heads)


def head_dim_or_split(own: Column, hidden: Column, attention_heads: Column) -> Column:
    return F.coalesce(own, F.floor(hidden / attention_heads))


def stored_bytes_per_param(weight_bytes: Column, param_count: Column) -> Column:
    return F.when(param_count > 0, weight_bytes / param_count).otherwise(F.lit(2.0))


def has_architecture(num_layers: Column, num_kv_heads: Column, head_dim: Column) -> Column:
    return num_layers.isNotNull() & num_kv_heads.isNotNull() & head_dim.isNotNull()


def kv_cache_gb(layers: Column, kv_heads: Column, head_dim: Column, context: Column, batch: Column) -> Column:
    """K and V of every layer, cached in 16 bits; 0 while the architecture is unknown."""
    values = exact_product(F.lit(4), layers, kv_heads, head_dim, context, batch)
    return F.when(has_architecture(layers, kv_heads, head_dim), gib(values)).otherwise(F.lit(0.0))


def activations_gb(hidden: Column, layers: Column, params: Column, context: Column, batch: Column) -> Column:
    """Training activations under checkpointing; scaled from params if shapes are unknown."""
    known = hidden.isNotNull() & layers.isNotNull()
    values = exact_product(F.lit(8), hidden, layers, context, batch)
    return F.when(known, gib(values)).otherwise(
        gib(exact_product(F.lit(2), params)) * F.lit(0.15)
    )


def per_gpu_vram_gb(total_vram_gb: Column, num_gpus: Column) -> Column:
    """Per-GPU need with the total spread evenly plus a fixed overhead."""
    return total_vram_gb / F.greatest(F.lit(1), num_gpus) + F.lit(C.PER_GPU_OVERHEAD_GB)


def min_vram_gb(total_vram_gb: Column, num_gpus: Column) -> Column:
    return F.ceil(per_gpu_vram_gb(total_vram_gb, num_gpus))


def estimate_notes(source: Column, known_architecture: Column, goal: Column) -> Column:
    def note(applies: Column, text: str) -> Column:
        none = F.array().cast("array<string>")
        return F.when(applies, F.array(F.lit(text))).otherwise(none)

    return F.concat(
        note(source != "safetensors", C.NOTE_FILE_SIZE),
        note(~known_architecture, C.NOTE_NO_ARCHITECTURE),
        note(goal == "qlora", C.NOTE_QLORA),
    )
