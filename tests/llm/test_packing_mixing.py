import random

import pytest
from pyspark.sql import functions as F

from quirewise.llm import mixing, packing


@pytest.mark.parametrize("shard", [2000, 40])
def test_packs_hold_everything_once(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    rng = random.Random(1)
    sizes = {i: rng.choice([rng.randint(0, 90), rng.randint(0, 400)]) for i in range(400)} | {900: 100, 901: 200, 902: 0}
    rows = [(i, s, "x") for i, s in sizes.items()] + [(903, None, "x"), (904, -5, "x")]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, bin string")
    packs = spark.createDataFrame([("s", 100), ("w", 1000), ("none", 0), ("null", None)], "pack string, capacity_tokens int")
    out = packing.pack(items, packs).collect()
    for name, cap in (("s", 100), ("w", 1000)):
        mine = [r for r in out if r["pack"] == name]
        fill, held = {}, {}
        for r in mine:
            fill[r["bin"]] = fill.get(r["bin"], 0) + r["tokens"]
            held.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
        assert all(v <= cap for v in fill.values())
        assert all(fill[r["bin"]] == r["fill"] and r["capacity"] == cap for r in mine)
        assert set(held) == {r[0] for r in rows}
        for i, s, _ in rows:
            pieces = sorted(held[i])
            s = max(s or 0, 0)
            assert [p for p, _ in pieces] == list(range(len(pieces))) and sum(t for _, t in pieces) == s
            assert len(pieces) == max(1, -(-s // cap))
        least = -(-sum(max(s or 0, 0) for _, s, _ in rows) // cap)
        assert len([b for b, f in fill.items() if f]) <= least * 1.01 + 1
    assert {r["pack"] for r in out} == {"s", "w"}


def test_pack_empty(spark):
    items = spark.createDataFrame([], "doc_id long, n_tokens long")
    packs = spark.createDataFrame([("s", 100)], "pack string, capacity_tokens int")
    assert packing.pack(items, packs).count() == 0
    assert packing.pack(items, packs.limit(0)).count() == 0


def test_shards_lose_their_ends_once(spark, monkeypatch):
    """Many small shards fill hardly more packs than one best-fit pass over everything; one more shard than items is none."""
    import numpy as np

    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 300, 3000)
    monkeypatch.setattr(packing, "SHARD", 100)
    monkeypatch.setattr(packing, "LEAST_BINS", 4)
    items = spark.createDataFrame([(k, int(s)) for k, s in enumerate(sizes)], "doc_id long, n_tokens long")
    packs = spark.createDataFrame([("a", 500), ("b", 5000)], "pack string, capacity_tokens int")
    got = {r["pack"]: r["n"] for r in packing.pack(items, packs).groupBy("pack").agg(F.countDistinct("bin").alias("n")).collect()}
    for name, cap in (("a", 500), ("b", 5000)):
        whole = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), cap, np.full(3000, -1), [])
        assert got[name] <= (int(whole.max()) + 1) * 1.005 + 1


def test_capacity_beyond_a_shard_and_too_many_packs(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_ITEMS", 50)
    items = spark.createDataFrame([(k, 3) for k in range(400)], "doc_id long, n_tokens long")
    out = packing.pack(items, spark.createDataFrame([("huge", 1 << 40)], "pack string, capacity_tokens bigint")).collect()
    assert len(out) == 400 and sum(r["tokens"] for r in out) == 1200
    many = spark.range(1001).selectExpr("cast(id as string) pack", "id + 1 capacity_tokens")
    with pytest.raises(ValueError):
        packing.pack(items, many)


def test_replacement_fills_bins_better():
    import numpy as np

    sizes = np.array([60, 30, 40, 35, 38])
    child = packing.settle(np.array([0, 0, 1, -1, 1]), sizes, 100)
    assert child.min() == 0 and np.bincount(child, weights=sizes).max() <= 100
    assert child[3] == 0 and child[1] != 0


def test_crossover_keeps_a_valid_packing():
    import numpy as np

    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 60, 300)
    down = np.argsort(-sizes, kind="stable")
    a = packing.best_fit(sizes, down, 100, np.full(300, -1), [])
    b = packing.best_fit(sizes, rng.permutation(300), 100, np.full(300, -1), [])
    for _ in range(20):
        child = packing.crossover(a, b, sizes, 100, rng)
        assert child.min() == 0 and np.bincount(child, weights=sizes).max() <= 100
        assert packing.fitness(child, sizes, 100) > 0
    best = packing.evolve(sizes, 100, 1, [])
    assert packing.fitness(best[0], sizes, 100) >= packing.fitness(a, sizes, 100)


def test_mix_meets_shares(spark):
    rng = random.Random(2)
    rows = [(i, rng.choices(["a", "b", "c", None, "other"], [60, 25, 10, 3, 2])[0], rng.randint(0, 500), "x") for i in range(6000)] + [(9001, "a", None, "x")]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 4), ("absent", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(items, targets)
    most = {"a": 1, "b": 2, "c": 4}
    by = {r[0]: r for r in rows}
    got = chosen.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    for r in got:
        assert r["source"] == by[r["doc_id"]][1] and 1 <= r["copies"] <= most[r["source"]] and r["n_tokens"] == by[r["doc_id"]][2] > 0
    s = {r["source"]: r for r in shares.collect()}
    assert set(s) == {"a", "b", "c", "absent"} and s["absent"]["chosen_tokens"] == 0
    for k, t in (("a", 0.3), ("b", 0.4), ("c", 0.2)):
        assert abs(s[k]["actual_share"] - t / 0.9) < 0.01
        assert s[k]["chosen_tokens"] == sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == k)
    full = min(s[k]["available_tokens"] * most[k] / t for k, t in (("a", 0.3), ("b", 0.4), ("c", 0.2))) * 0.9
    assert abs(sum(r["chosen_tokens"] for r in s.values()) / full - 1) < 0.02


def test_mix_empty_and_ties(spark):
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    same = spark.createDataFrame([(i, "a", 10) for i in range(50)], "doc_id long, source string, n_tokens long")
    assert {(r["doc_id"], r["copies"]) for r in mixing.mix(same, targets)[0].collect()} == {(i, 3) for i in range(50)}
    chosen, shares = mixing.mix(same.limit(0), targets)
    assert chosen.count() == 0 and shares.first()["actual_share"] == 0.0
    assert mixing.mix(same, targets.limit(0))[0].count() == 0


def test_mix_in_many_parts(spark, monkeypatch):
    """More parts change which documents are drawn, not how much of each source."""
    items = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'a', 'b') source", "id % 97 + 1 n_tokens")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 1)], "source string, target_share double, max_repeats int")
    shares = []
    for cell in (1_000_000, 5):
        monkeypatch.setattr(mixing, "CELL", cell)
        shares.append({r["source"]: r["actual_share"] for r in mixing.mix(items, targets)[1].collect()})
    assert all(abs(s["a"] - 0.6) < 0.01 for s in shares)
