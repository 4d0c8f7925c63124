import random
import re

import numpy as np
import pytest

from quirewise.llm import blocks, nearcopies


def closeness(a, b, k):
    sh = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (re.findall(r"[^\W_]+", x.lower()) for x in (a, b))]
    return len(sh[0] & sh[1]) / len(sh[0] | sh[1])


def texts(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split()
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = [rng.choice(words)]
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randint(8, 40))))
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
@pytest.mark.parametrize("k,num,den,block,flat", [(3, 1, 2, 2048, 64), (3, 1, 2, 8, 4), (5, 4, 5, 2048, 4), (2, 1, 5, 16, 2)])
def test_links_against_brute_force(spark, monkeypatch, k, num, den, block, flat, broadcast):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "FLAT", flat)
    monkeypatch.setattr(blocks, "MOST_BROADCAST", broadcast)
    rows = [(i, t, "clash") for i, t in enumerate(texts(k * 10 + den))]
    rows += [(900, None, "x"), (901, "", "x"), (902, "too short", "x"), (903, rows[0][1].upper() + "!", "x"), (None, rows[1][1], "x")]
    df = spark.createDataFrame(rows, "id long, text string, cls string")
    members, links = nearcopies.near_copies(df, "id", "text", k=k, num=num, den=den, least_words=8)
    cls = {r["id"]: bytes(r["cls"]) for r in members.collect()}
    assert not {900, 901, 902, None} & set(cls) and cls[903] == cls[0]
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links.collect()}
    by = {i: t for i, t, _ in rows if i in cls}
    want = set()
    ids = sorted(by)
    for x in ids:
        for y in ids:
            if x < y and den * round(closeness(by[x], by[y], k) * 10**9) >= num * 10**9 - den:
                if cls[x] != cls[y]:
                    want.add(frozenset((cls[x], cls[y])))
            elif x < y:
                assert cls[x] != cls[y]
    assert got == want and want


def test_groups_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h i"), (3, "a b c d e f g h j"), (4, "q r s t u v w x y")], "id long, text string")
    members, links = nearcopies.near_copies(df, "id", "text", k=3, num=1, den=2)
    got = {r["id"]: (r["grp"], r["n_links"]) for r in nearcopies.near_groups(members, links, "id").collect()}
    assert got[1] == got[2] and got[1][0] == got[3][0] != got[4][0] and got[3][1] == 1 and got[4][1] == 0
    members, links = nearcopies.near_copies(df.limit(0), "id", "text", k=3, num=1, den=2)
    assert members.count() == 0 and links.count() == 0


def test_long_text(spark):
    long = " ".join(f"w{i % 5000}x{i % 77}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 " * 50_000)], "id long, text string")
    _, links = nearcopies.near_copies(df, "id", "text")
    assert links.count() == 1


def test_vectors_of_any_count():
    import pandas as pd

    v = np.random.default_rng(1).integers(0, 255, (6, nearcopies.GROUPS))
    v[2, 3], v[4, 0] = 256, 10**6
    assert (nearcopies._unpacked(pd.Series([nearcopies._packed(x) for x in v])) == v).all()


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(3)
    v = rng.poisson(1.0, (300, nearcopies.GROUPS)).astype(np.uint16)
    v[150:] = v[:150] + rng.poisson(0.05, (150, nearcopies.GROUPS)).astype(np.uint16)
    n = v.sum(1).astype(np.int64)
    a, b = nearcopies._search(v, n, v, n, 4, 5)
    bound = np.minimum(v[:, None].astype(int), v[None].astype(int)).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero(bound * 9 >= 4 * (n[:, None] + n[None])))}
    assert {(int(i), int(j)) for i, j in zip(a, b)} == want
