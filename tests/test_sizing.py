import math

import pytest
from pyspark.sql import functions as F

from slipway import schemas as S
from slipway.functions.numbers import exact_product, round_cents, round_columns
from slipway.operators import memory, sizing

GIB = 1024**3


def rows(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_weight_rollup(spark):
    files = spark.createDataFrame(
        [
            ("two", "model-00001-of-00002.safetensors", 10 * GIB),
            ("two", "model-00002-of-00002.safetensors", 12 * GIB),
            ("two", "README.md", 999),
            ("one", "model.safetensors", 30 * GIB),
            ("none", "README.md", 5),
            ("mixed", "optimizer.pt", 5 * GIB),
            ("mixed", "model.BIN", GIB),
            ("both", "a.bin", GIB),
            ("both", "a.safetensors", GIB),
            ("bad", "a.pth", -4),
            ("bad", "b.gguf", None),
            ("bad", "c.bin.txt", 7),
        ],
        S.MODEL_FILES,
    )
    asked = spark.createDataFrame([("two",), ("gone",)], "model_id string")
    found = rows(sizing.model_size_report(files, asked), "model")
    assert {m: r.size_gb for m, r in found.items()} == {
        "two": 22.0, "one": 30.0, "none": None, "mixed": 1.0, "both": 2.0, "bad": None, "gone": None,
    }
    assert {m: r.suggested_network_volume_gb for m, r in found.items()} == {
        "two": 55, "one": 75, "none": 160, "mixed": 50, "both": 50, "bad": 160, "gone": 160,
    }
    assert found["gone"].source == "unavailable" and found["none"].source == "metadata"


def test_param_rollup(spark):
    counts = spark.createDataFrame(
        [
            ("a", "BF16", 100), ("a", "F32", 10), ("a", "I4", 3),
            ("b", "NEW_TAG", 7),
            ("c", "bf16", 5),
            ("d", "F4", 1), ("d", "U4", 1), ("d", "I4", 1),
            ("zero", "F32", 0),
        ],
        S.TENSOR_COUNTS,
    )
    found = {r.model_id: (r.param_count, r.weight_bytes) for r in sizing.param_rollup(counts).collect()}
    assert found == {"a": (113, 241), "b": (7, 14), "c": (5, 10), "d": (3, 1)}


def test_counts_past_64_bits_are_rejected_rows(spark):
    big = 2**62
    counts = spark.createDataFrame(
        [("sum", "I4", big), ("sum", "I4", big), ("product", "F64", big), ("fine", "F64", 2**58), ("none", "F64", None)],
        S.TENSOR_COUNTS,
    )
    found = {r.model_id: (r.param_count, r.weight_bytes) for r in sizing.param_rollup(counts).collect()}
    assert found == {"sum": (None, None), "product": (None, None), "fine": (2**58, 2**61)}
    files = spark.createDataFrame([("huge", "a.bin", 2**62 + 3)] * 5 + [("fine", "b.bin", 1)], S.MODEL_FILES)
    sizes = {r.model_id: r.size_gb for r in sizing.weight_file_rollup(files).collect()}
    assert sizes == {"huge": 5 * (2**62 + 3) / 2**30, "fine": 1 / 2**30}
    specs = rows(sizing.resolve_specs(counts, files, spark.createDataFrame([], S.MODEL_CONFIGS)), "model_id")
    reasons = {m: r.reject_reason for m, r in specs.items()}
    assert {m for m, reason in reasons.items() if reason == "counts pass 64 bits"} == {"sum", "product", "huge"}
    assert reasons["none"].startswith("no safetensors metadata")
    assert specs["fine"].param_count == 2**58 and specs["huge"].weight_bytes is None


CONFIGS = [
    ("plain", '{"hidden_size": 4096, "num_hidden_layers": 32, "num_attention_heads": 32, '
     '"num_key_value_heads": 8, "max_position_embeddings": 131072}', (4096, 32, 8, 128, 131072)),
    ("nested", '{"vision_config": {"hidden_size": 1024}, "text_config": {"hidden_size": 2048, '
     '"num_hidden_layers": 16, "num_attention_heads": 16}}', (2048, 16, 16, 128, None)),
    ("text number", '{"hidden_size": "4096", "n_embd": 768}', (768, None, None, None, None)),
    ("null hides", '{"hidden_size": 1024, "text_config": {"hidden_size": null}}', (None,) * 5),
    ("bad hides", '{"n_layer": 3, "text_config": {"n_layer": 2.0}}', (None,) * 5),
    ("float", '{"hidden_size": 4096.0, "n_embd": 1e3, "d_model": 12}', (12, None, None, None, None)),
    ("zero", '{"hidden_size": 0, "n_layer": -1, "num_layers": 4}', (None, 4, None, None, None)),
    ("true", '{"hidden_size": true, "n_head": false}', (1, None, None, None, None)),
    ("small", '{"hidden_size": 3, "n_head": 4}', (3, None, 4, 0, None)),
    ("huge", '{"hidden_size": 99999999999999999999, "d_model": 8}', (8, None, None, None, None)),
    ("twice", '{"n_layer": 2, "n_layer": 5}', (None, 5, None, None, None)),
    ("list", "[1]", (None,) * 5),
    ("broken", "{", (None,) * 5),
    ("broken inside", '{"n_layer": 2, "text_config": {"n_embd": bad}}', (None,) * 5),
    ("broken after", '{"n_layer": 2, "other": [1,}', (None,) * 5),
    ("quotes", "{'n_layer': 2}", (None,) * 5),
    ("other case", '{"N_LAYER": 2}', (None,) * 5),
    ("missing", None, (None,) * 5),
    ("text is text", '{"n_positions": 9, "text_config": "x"}', (None, None, None, None, 9)),
]


def test_architecture(spark):
    configs = spark.createDataFrame([c[:2] for c in CONFIGS], S.MODEL_CONFIGS)
    found = {
        r.model_id: (r.hidden_size, r.num_layers, r.num_kv_heads, r.head_dim, r.max_context)
        for r in sizing.extract_architecture(configs).collect()
    }
    assert found == {name: expected for name, _, expected in CONFIGS}


def test_specs_prefer_tensor_counts(spark):
    counts = spark.createDataFrame([("a", "F32", 10), ("zero", "F32", 0)], S.TENSOR_COUNTS)
    files = spark.createDataFrame(
        [("a", "x.bin", 999), ("zero", "x.bin", 2001), ("files", "x.bin", 7), ("nothing", "x.md", 1)],
        S.MODEL_FILES,
    )
    configs = spark.createDataFrame(
        [("a", '{"n_layer": 2}'), ("only config", '{"n_layer": 2}')], S.MODEL_CONFIGS
    )
    found = rows(sizing.resolve_specs(counts, files, configs), "model_id")
    brief = {m: (r.param_count, r.weight_bytes, r.source) for m, r in found.items()}
    assert brief == {
        "a": (10, 40, "safetensors"),
        "zero": (1000, 2001, "file-size"),
        "files": (3, 7, "file-size"),
        "nothing": (None, None, None),
        "only config": (None, None, None),
    }
    assert found["a"].num_layers == 2 and found["a"].reject_reason is None
    assert found["nothing"].reject_reason and found["only config"].reject_reason


B = 10**9
SPECS = [
    ("base", B, 2 * B, 2048, 24, 8, 128, 32768, "safetensors"),
    ("short", B, 2 * B, 2048, 24, 8, 128, 1024, "safetensors"),
    ("shapeless", B, 2 * B, None, None, None, None, None, "file-size"),
    ("fp32", 7 * B, 28 * B, 2048, 24, 8, 128, 32768, "safetensors"),
    ("bf16", 7 * B, 14 * B, 2048, 24, 8, 128, 32768, "safetensors"),
    ("empty", 0, 0, 2048, 24, 8, 128, 32768, "safetensors"),
]
# specs, goal -> ctx, weights, kv, act, opt, total, RAM, disk, VRAM for 1/2/4/8 GPUs
EXPECTED = {
    ("base", "inference"): (8192, 1.86, 0.75, 0, 0, 3.61, 16, 50, (6, 4, 3, 3)),
    ("base", "lora"): (2048, 1.86, 0, 0.75, 0.07, 3.69, 16, 50, (6, 4, 3, 3)),
    ("base", "qlora"): (2048, 0.51, 0, 0.75, 0.07, 2.34, 16, 50, (5, 4, 3, 3)),
    ("base", "full"): (2048, 1.86, 0, 0.75, 13.04, 17.14, 16, 50, (20, 11, 7, 5)),
    ("short", "inference"): (1024, 1.86, 0.09, 0, 0, 2.96, 16, 50, (5, 4, 3, 3)),
    ("shapeless", "inference"): (8192, 1.86, 0, 0, 0, 2.86, 16, 50, (5, 4, 3, 3)),
    ("shapeless", "full"): (2048, 1.86, 0, 0.28, 13.04, 16.67, 16, 50, (19, 11, 7, 5)),
    ("fp32", "inference"): (8192, 26.08, 0.75, 0, 0, 29.43, 40, 66, (32, 17, 10, 6)),
    ("fp32", "full"): (2048, 13.04, 0, 0.75, 91.27, 115.49, 53, 105, (118, 60, 31, 17)),
    ("bf16", "full"): (2048, 13.04, 0, 0.75, 91.27, 115.49, 27, 53, (118, 60, 31, 17)),
}


def test_memory_and_fit(spark):
    specs = spark.createDataFrame(SPECS, S.MODEL_SPECS)
    scenarios = [(goal, None, 1) for goal in ("inference", " LoRA", "qlora", "FULL", "distill")]
    estimates = memory.estimate_memory(memory.with_scenarios(specs, scenarios))
    found = rows(estimates, "model_id", "goal")
    fits = rows(memory.gpu_fit_table(estimates), "model_id", "goal", "num_gpus")
    for key, (ctx, w, kv, act, opt, total, ram, disk, vram) in EXPECTED.items():
        r = found[key]
        assert (
            r.context_len, r.weights_gb, r.kv_cache_gb, r.activations_gb, r.optimizer_gb,
            r.total_vram_gb, r.host_ram_gb, r.disk_gb,
        ) == (ctx, w, kv, act, opt, total, ram, disk), key
        assert tuple(fits[(*key, n)].min_vram_per_gpu_gb for n in (1, 2, 4, 8)) == vram, key
    assert [
        (fits[("fp32", "full", n)].cheapest_gpu, fits[("fp32", "full", n)].estimated_dollars_per_hour)
        for n in (1, 2, 4, 8)
    ] == [
        ("NVIDIA H200", 3.59), ("NVIDIA A100 80GB PCIe", 2.38), ("NVIDIA A40", 2.96),
        ("NVIDIA GeForce RTX 3090", 1.76),
    ]
    rejected = found[("base", "distill")]
    assert rejected.total_vram_gb is None and "distill" in rejected.reject_reason
    assert fits[("base", "distill", 1)].cheapest_gpu is None
    assert found[("empty", "full")].total_vram_gb == 0.75
    assert [len(found[("shapeless", g)].notes) for g in ("inference", "qlora")] == [2, 3]
    assert found[("base", "inference")].notes == []


def test_context_is_kept_when_given_and_capped_when_not(spark):
    specs = spark.createDataFrame(SPECS[1:2], S.MODEL_SPECS)
    found = memory.estimate_memory(
        memory.with_scenarios(specs, [("inference", 65536, 4), ("inference", None, 4)])
    ).collect()
    assert sorted(r.context_len for r in found) == [1024, 65536]


# Per case: parameters, bytes of weights, hidden size, layers, KV heads, head size, goal, context, batch;
# then weights, KV cache, activations, optimizer and total in GiB, worked out by hand.
GIB_PARAMS = 2**30
WORKED = {
    "fp16 inference": ((GIB_PARAMS, 2 * GIB_PARAMS, 1024, 32, 8, 128, "inference", 8192, 1), (2.0, 1.0, 0.0, 0.0, 4.0)),
    "twice the batch": ((GIB_PARAMS, 2 * GIB_PARAMS, 1024, 32, 8, 128, "inference", 8192, 2), (2.0, 2.0, 0.0, 0.0, 5.0)),
    "one byte weights": ((16 * GIB_PARAMS, 16 * GIB_PARAMS, 1024, 32, 8, 128, "inference", 8192, 1), (16.0, 1.0, 0.0, 0.0, 18.6)),
    "lora": ((8 * GIB_PARAMS, 16 * GIB_PARAMS, 1024, 32, 8, 128, "lora", 2048, 1), (16.0, 0.0, 0.5, 0.64, 18.74)),
    "qlora": ((20 * GIB_PARAMS, 40 * GIB_PARAMS, 1024, 32, 8, 128, "qlora", 2048, 2), (11.0, 0.0, 1.0, 1.6, 15.25)),
    "full": ((GIB_PARAMS, 2 * GIB_PARAMS, 1024, 32, 8, 128, "full", 2048, 1), (2.0, 0.0, 0.5, 14.0, 18.1)),
    "fp32 full": ((GIB_PARAMS, 4 * GIB_PARAMS, 1024, 32, 8, 128, "full", 2048, 1), (2.0, 0.0, 0.5, 14.0, 18.1)),
}
ESTIMATE_INPUT = (
    "model_id string, param_count bigint, weight_bytes bigint, hidden_size bigint, num_layers bigint, "
    "num_kv_heads bigint, head_dim bigint, max_context bigint, source string, goal string, "
    "context_len bigint, batch_size bigint"
)


def _estimated(spark, cases):
    frame = spark.createDataFrame([(name, *c[:6], None, "safetensors", *c[6:]) for name, c in cases.items()], ESTIMATE_INPUT)
    parts = ("weights_gb", "kv_cache_gb", "activations_gb", "optimizer_gb", "total_vram_gb")
    return {name: tuple(r[p] for p in parts) for name, r in rows(memory.estimate_memory(frame), "model_id").items()}


def test_worked_memory_estimates(spark):
    assert _estimated(spark, {name: c for name, (c, _) in WORKED.items()}) == {n: want for n, (_, want) in WORKED.items()}


def test_relations_between_goals(spark):
    import random

    draw = random.Random(5)
    shapes = {}
    for i in range(300):
        params = draw.randint(10**9, 10**11)
        shapes[i] = (params, 2 * params, draw.randint(512, 20000), draw.randint(1, 200), draw.randint(1, 128), 128)
    found = _estimated(
        spark,
        {f"{i} {goal} {batch}": (*s, goal, 4096, batch) for i, s in shapes.items()
         for goal in ("inference", "lora", "qlora", "full") for batch in (1, 2)},
    )
    for i in shapes:
        inference, lora, qlora, full = (found[f"{i} {goal} 1"] for goal in ("inference", "lora", "qlora", "full"))
        assert inference[0] == lora[0] == full[0] > qlora[0]
        assert inference[2] == inference[3] == lora[1] == qlora[1] == full[1] == 0
        assert lora[2] == qlora[2] == full[2] and lora[3] == qlora[3]
        assert full[3] == pytest.approx(7 * full[0], abs=0.05)
        assert full[4] > lora[4] > qlora[4]
        for goal, part in (("inference", 1), ("lora", 2)):
            one, two = found[f"{i} {goal} 1"], found[f"{i} {goal} 2"]
            assert two[part] == pytest.approx(2 * one[part], abs=0.02)
            assert two[4] - one[4] == pytest.approx(one[part], abs=0.03)
        for parts in (inference, lora, qlora, full):
            assert parts[4] >= sum(parts[:4]) + 0.95


def test_huge_shapes_do_not_overflow(spark):
    big = 2**62
    specs = spark.createDataFrame([("x", big, big, big, big, big, big, None, "safetensors")], S.MODEL_SPECS)
    found = memory.estimate_memory(memory.with_scenarios(specs, [("inference", None, 1)])).first()
    assert math.isfinite(found.kv_cache_gb) and found.kv_cache_gb > 1e50


@pytest.mark.parametrize("value", [2.675, 1.005, 0.125, 0.375, 2.5, 0.015, 1e9 + 0.005, 0.0, 1e12 + 0.125, 5e13 + 0.0078125, 1e300])
def test_round_cents_is_exact(spark, value):
    frame = spark.range(1).select(F.lit(value).alias("x"), F.lit(-value).alias("y"), "id")
    assert frame.select(round_cents(F.col("x"))).first()[0] == round(value, 2)
    assert tuple(round_columns(frame, "x", "y").first()) == (round(value, 2), round(-value, 2), 0)


def test_exact_product(spark):
    big = 3037000499
    found = spark.range(1).select(exact_product(F.lit(big), F.lit(big), F.lit(1))).first()[0]
    assert found == float(big * big)


def test_long_catalogs_and_scenarios(spark):
    specs = spark.createDataFrame(SPECS[:1], S.MODEL_SPECS)
    many = memory.with_scenarios(specs, [("lora", None, batch) for batch in range(1, 1202)])
    assert many.count() == 1201
    prices = [(f"gpu-{n}", 10_000, 2.0 + n, 2.0 + n) for n in range(1500)] + [("cheap", 20_000, 1.0, 1.0)]
    one = memory.estimate_memory(memory.with_scenarios(specs, [("lora", None, 1)]))
    fits = memory.gpu_fit_table(one, catalog=prices).filter("num_gpus = 1")
    assert fits.first().cheapest_gpu in ("cheap", "gpu-0")
