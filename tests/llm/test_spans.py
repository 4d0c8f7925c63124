import random

import pytest
from pyspark.sql import functions as F

from quirewise.llm import spans


def brute(docs, least):
    seen = {}
    for d, t in docs:
        w = (t or "").split()
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = set()
    for d, t in docs:
        w = (t or "").split()
        mark = [False] * len(w)
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                mark[i : i + least] = [True] * least
        i = 0
        while i < len(w):
            if mark[i]:
                j = i
                while j < len(w) and mark[j]:
                    j += 1
                out.add((d, i, j - i))
                i = j
            else:
                i += 1
    return out


def docs(seed, least):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choices(words, k=rng.randint(least - 1, 3 * least)) for _ in range(6)]
    out = []
    for d in range(60):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += rng.choices(words, k=rng.randint(0, 30))
            if rng.random() < 0.5:
                s = rng.choice(shared)
                cut = rng.randint(0, len(s) // 2)
                t += s[cut:]
        out.append((d, rng.choice([" ", "\n", "  \t"]).join(t)))
    hot = " ".join(shared[0])
    out += [(100 + k, f"{rng.choice(words)} {hot} {rng.choice(words)}") for k in range(40)]
    out += [(500, None), (501, ""), (502, "x " * (3 * least)), (503, " ".join(["y", "z"] * least) + " q " + " ".join(["y", "z"] * least))]
    return out


@pytest.mark.parametrize("least,hot,chunk", [(40, 20_000, 400_000), (12, 1, 400_000), (15, 20_000, 64), (8, 1, 50)])
def test_against_brute_force(spark, monkeypatch, least, hot, chunk):
    monkeypatch.setattr(spans, "HOT_ROWS", hot)
    monkeypatch.setattr(spans, "CHUNK", chunk)
    monkeypatch.setattr(spans, "HINT_SAMPLE", 2)
    rows = docs(least, least)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int").repartition(5)
    got = {tuple(r) for r in spans.shared_spans(df, least=least).collect()}
    assert got == brute(rows, least) and got


def test_share_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, t + " x"), (2, t), (3, ""), (4, None)], "doc_id long, text string")
    found = spans.shared_spans(df)
    got = {r["doc_id"]: (r["n_words"], r["n_shared"], round(r["share"], 4)) for r in spans.shared_share(df, found).collect()}
    assert got == {1: (51, 50, 0.9804), 2: (50, 50, 1.0), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_very_long(spark):
    long = " ".join(f"w{i}" for i in range(900_000))
    df = spark.createDataFrame([(1, long), (2, "a " + long[5_000:])], "doc_id long, text string")
    assert spans.shared_spans(df).agg(F.count("*")).first()[0] == 2


@pytest.mark.parametrize("hot", [1, 10**9])
def test_hot_window_in_two_pieces_of_one_document(spark, monkeypatch, hot):
    """A document taken in pieces holds a hot window in each, another document holds it beside the first only."""
    monkeypatch.setattr(spans, "HOT_ROWS", hot)
    monkeypatch.setattr(spans, "CHUNK", 12)
    monkeypatch.setattr(spans, "HINT_SAMPLE", 1)
    stock = "s0 s1 s2 s3"
    rows = [(1, f"{stock} " + " ".join(f"a{k}" for k in range(14)) + f" {stock} b0 b1"), (2, f"c0 {stock} c1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert {tuple(r) for r in spans.shared_spans(df, least=3).collect()} == brute(rows, 3)
