"""Blocks of frequent shingles: only rows that size and place allow are looked at, whatever their number."""

import numpy as np
import pytest
from test_nearcopies import closeness, texts

from quirewise.llm import nearcopies


def test_ranges_against_all_pairs():
    rng = np.random.default_rng(5)
    block = np.sort(rng.integers(0, 4, 400))
    n = rng.integers(6, 60, 400)
    order = np.lexsort((n, block))
    n = n[order]
    rest = n - rng.integers(0, n // 2 + 1)
    side = np.where(block == 2, rng.integers(1, 3, 400), 0)
    v = np.stack([np.bincount(rng.integers(0, nearcopies.GROUPS, m), minlength=nearcopies.GROUPS) for m in n])
    v[1::2] = v[::2]
    n[1::2], rest[1::2] = v[1::2].sum(1), np.minimum(rest[1::2], v[1::2].sum(1))
    order = np.lexsort((n, block))
    n, rest, side, v = n[order], rest[order], side[order], v[order]
    a, b = nearcopies._meeting(block, n, rest, side, nearcopies._bits(v), 1, 2, np.zeros(400, bool))
    got = {(int(x), int(y)) for x, y in zip(a, b)}
    every = [(i, j) for i in range(400) for j in range(i + 1, 400) if block[i] == block[j] and (side[i] != side[j] or not side[i])]
    may = {(i, j) for i, j in every if 2 * min(n[i], n[j]) >= max(n[i], n[j]) and 3 * min(rest[i], rest[j]) >= n[i] + n[j]}
    sure = {(i, j) for i, j in may if 3 * np.minimum(v[i], v[j]).sum() >= n[i] + n[j]}
    assert sure and sure <= got <= may and len(got) == len(a)


def test_late_places_meet_nobody():
    # 20,000 sets of one size that share a shingle behind the place where alike sets must have met: 200 million pairs, none looked at.
    m = 20_000
    n, rest, bits = np.full(m, 45), np.full(m, 25), [np.zeros(m, np.uint64)] * nearcopies.STEPS
    a, _ = nearcopies._meeting(np.zeros(m, int), n, rest, np.zeros(m, int), bits, 1, 2, np.zeros(m, bool))
    assert not len(a)


def test_buckets_follow_classes():
    assert nearcopies._buckets(0) == nearcopies._buckets(100_000) == nearcopies.BUCKETS
    assert nearcopies._buckets(2_000_000) == 1 << 23 and nearcopies._buckets(10**9) == nearcopies.MOST_BUCKETS


@pytest.mark.parametrize("block,flat", [(2048, 2), (8, 2), (2048, 64)])
def test_long_sets_too(spark, monkeypatch, block, flat):
    monkeypatch.setattr(nearcopies, "WIDE", 20)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "FLAT", flat)
    rows = dict(enumerate(texts(7)))
    members, links = nearcopies.near_copies(spark.createDataFrame(list(rows.items()), "id long, text string"), "id", "text", k=3, num=1, den=2)
    cls = {r["id"]: bytes(r["cls"]) for r in members.collect()}
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links.collect()}
    want = {frozenset((cls[x], cls[y])) for x in rows for y in rows if x < y and cls[x] != cls[y] and closeness(rows[x], rows[y], 3) >= 0.5}
    assert got == want and want
