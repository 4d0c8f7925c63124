"""The structural comparison against a plain sequential one, and its golden scenarios."""

import random
from difflib import SequenceMatcher
from itertools import product

import pytest

from quirewise.functions import text as T
from quirewise.operators import revision as R
from quirewise.operators import tables as B
from quirewise.operators.assign import greedy_pairs
from pyspark.sql import functions as F

WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("arin", "olt", "ume", "ekko", "ist")]
SCHEMA = "pair_id string, side string, number int, text string, is_heading boolean, heading_level int, section_id string"


def document(pair, side, items):
    """items: (level or 0, text) in order."""
    rows, section, n = [], "S0", 0
    for k, (level, text) in enumerate(items, 1):
        if level:
            n += 1
            section = f"S{n}"
        rows.append((pair, side, k, text, bool(level), level, section))
    return rows


def jac(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0


def plain_sections(rows):
    out, stack = [{"id": "S0", "level": 0, "text": "", "title": "", "ord": 0, "under": set()}], []
    for r in rows:
        if r[4]:
            stack = [s for s in stack if s["level"] < r[5]]
            s = {"id": r[6], "level": r[5], "text": r[3], "title": T.re.sub(r"^\d+(?:\.\d+)*[.)]?\s+", "", r[3]), "ord": len(out), "under": set()}
            out.append(s)
            stack.append(s)
        else:
            for s in stack or out[:1]:
                s["under"] |= {t for t in T.plain_tokens(r[3]) if t not in T.STOPWORDS}
    return out


def plain_match(o, r):
    left, right, done = plain_sections(o), plain_sections(r), {"S0": "S0"}
    for key in (lambda s: T.plain(s["text"]), lambda s: T.plain(s["title"])):
        a, b = {}, {}
        for group, secs, used in ((a, left[1:], set(done)), (b, right[1:], set(done.values()))):
            for s in secs:
                if s["id"] not in used and key(s):
                    group.setdefault(key(s), []).append(s)
        done |= {v[0]["id"]: b[k][0]["id"] for k, v in a.items() if len(v) == 1 and len(b.get(k, ())) == 1}
    cand = []
    for x in left[1:]:
        for y in right[1:]:
            if x["id"] in done or y["id"] in done.values():
                continue
            h = R._title_ratio(x["title"], y["title"]) if x["title"] and y["title"] else 0.0
            c = jac(x["under"], y["under"]) if x["under"] or y["under"] else 0.0
            if h >= 0.8 or (c >= 0.5 and h >= 0.3) or c >= 0.75:
                place = 1 - abs((x["ord"] - 1) / max(1, len(left) - 1) - (y["ord"] - 1) / max(1, len(right) - 1))
                cand.append((-(0.55 * h + 0.3 * c + 0.1 * place + 0.05 * (x["level"] == y["level"])), x["ord"], y["ord"], x["id"], y["id"]))
    for *_, x, y in sorted(cand):
        if x not in done and y not in done.values():
            done[x] = y
    return done, [s["id"] for s in left], [s["id"] for s in right]


def plain_changes(o, r):
    done, lefts, rights = plain_match(o, r)
    found, rest_o, rest_r = {}, [], []
    of = lambda rows, s: [x for x in rows if x[6] == s]
    bag = lambda t: {w for w in T.plain_tokens(t) if w not in T.STOPWORDS}

    def near(a, b, least, wide):
        """Every pair is compared."""
        out = []
        for (i, x), (j, y) in product(enumerate(x[3] for x in a), enumerate(y[3] for y in b)):
            m, n = sorted((len(T.plain(x)), len(T.plain(y))))
            p, q = bag(x), bag(y)
            far = not wide and (len(p & q) / len(p | q) if p and q else float(p == q)) < R.OVERLAP
            if not far and not (m and m / n < R.SHORTEST) and (s := T.token_ratio(x, y)) >= least:
                out.append((i, j, s))
        return out

    def greedy(a, b, pairs):
        used_a, used_b, out = set(), set(), []
        for s, i, j in sorted(((s, i, j) for i, j, s in pairs), reverse=True):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((a[i], b[j], s))
        return out

    for s in lefts:
        if s not in done:
            rest_o += of(o, s)
            continue
        a, b = of(o, s), of(r, done[s])
        if a and b and a[0][4] and b[0][4]:
            found[a[0][2], b[0][2]] = "unchanged" if T.plain(a[0][3]) == T.plain(b[0][3]) else "modified"
        a, b = [x for x in a if not x[4]], [x for x in b if not x[4]]
        for tag, i, k, j, m in SequenceMatcher(None, [T.plain(x[3]) for x in a], [T.plain(x[3]) for x in b], autojunk=False).get_opcodes():
            if tag == "equal":
                found |= {(x[2], y[2]): "unchanged" for x, y in zip(a[i:k], b[j:m])}
                continue
            pairs = greedy(a[i:k], b[j:m], near(a[i:k], b[j:m], 0.5, True))
            found |= {(x[2], y[2]): "modified" for x, y, _ in pairs}
            rest_o += [x for x in a[i:k] if x not in [p[0] for p in pairs]]
            rest_r += [y for y in b[j:m] if y not in [p[1] for p in pairs]]
    for s in rights:
        if s not in done.values():
            rest_r += of(r, s)
    for x in list(rest_o):
        y = next((y for y in rest_r if T.plain(y[3]) == T.plain(x[3]) and T.plain(x[3])), None)
        if y:
            found[x[2], y[2]] = "moved"
            rest_o.remove(x)
            rest_r.remove(y)
    by = {}
    for i, j, s in near(rest_o, rest_r, 0.6, False):
        by.setdefault(i, []).append((s, j))
    pairs = [(i, j, s) for i, c in by.items() for s, j in sorted(c, reverse=True)[:4]]
    found |= {(x[2], y[2]): "moved" for x, y, _ in greedy(rest_o, rest_r, pairs)}
    a, b = {k[0] for k in found}, {k[1] for k in found}
    return found | {(x[2], None): "removed" for x in o if x[2] not in a} | {(None, y[2]): "added" for y in r if y[2] not in b}


def random_pair(seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choices(WORDS, k=rng.randint(5, 14))).capitalize() + "."
    titles = [" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(5)]
    one = []
    for n in range(rng.randint(2, 7)):
        one.append((rng.randint(1, 3), f"{n + 1} {rng.choice(titles)}"))
        one += [(0, " ".join(sentence() for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(0, 5))]
    one.insert(0, (0, sentence()))
    two = list(one)
    for _ in range(rng.randint(1, 8)):
        k = rng.randrange(len(two))
        level, text = two[k]
        what = rng.random()
        if what < 0.3:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            two[k] = (level, " ".join(words))
        elif what < 0.5:
            two.insert(rng.randrange(len(two)), two.pop(k))
        elif what < 0.65:
            two.pop(k)
        elif what < 0.8:
            two.insert(k, (0, sentence()))
        else:
            two.insert(rng.randrange(len(two)), (level, text))
    return one, two or [(0, "Left.")]


def test_against_the_sequential_comparison(spark):
    rows, want = [], {}
    for k in range(25):
        one, two = random_pair(k)
        o, r = document(f"P{k}", "original", one), document(f"P{k}", "revised", two)
        rows += o + r
        want[f"P{k}"] = plain_changes(o, r)
    p = spark.createDataFrame(rows, SCHEMA)
    s = R.section_tree(p)
    m = R.match_sections(s, p).cache()
    c = R.match_paragraphs(p, m)
    got = {}
    for x in c.collect():
        got.setdefault(x["pair_id"], {})[x["original"], x["revised"]] = x["kind"]
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert set(got) == set(want)
    d = R.describe_changes(c, p).collect()
    assert len(d) == sum(map(len, want.values()))
    for x in d:
        before = [v for (o, v) in want[x["pair_id"]] if o and v and x["original"] and o < x["original"]]
        assert x["place"] == (float(x["revised"]) if x["revised"] else max(before, default=0) + 0.5)
    total = {x["pair_id"]: x for x in R.change_summary(c, m).collect()}
    assert all(total[k]["paragraphs_modified"] == list(v.values()).count("modified") for k, v in want.items())


def test_wide_document(spark):
    body = lambda i, j: f"Sentence {i} and {j} about {WORDS[(i * 7 + j) % 60]} with {WORDS[(i + j * 5) % 60]} here."
    one = [x for i in range(40) for x in [(1, f"{i + 1} {WORDS[i]} heading"), *[(0, body(i, j)) for j in range(10)]]]
    two = [(lv, t + " One more sentence stands here." if t.startswith("Sentence") and " and 3 " in t else t) for lv, t in one]
    p = spark.createDataFrame(document("P", "original", one) + document("P", "revised", two), SCHEMA)
    m = R.match_sections(R.section_tree(p), p)
    got = {r["kind"]: r["n"] for r in R.match_paragraphs(p, m).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"modified": 40, "unchanged": 400}


def test_empty(spark):
    p = spark.createDataFrame([], SCHEMA)
    m = R.match_sections(R.section_tree(p), p)
    assert m.count() == 0 and R.match_paragraphs(p, m).count() == 0


def test_greedy_rounds_equal_the_pass(spark):
    rng = random.Random(5)
    rows = [(g, i, j, rng.randint(0, 9)) for g in range(5) for i in range(12) for j in range(12) if rng.random() < 0.5]
    got = {tuple(r) for r in greedy_pairs(spark.createDataFrame(rows, "g int, i int, j int, s int"), ["g"], "i", "j", [-F.col("s"), F.col("i"), F.col("j")]).collect()}
    want, used = set(), set()
    for g, i, j, s in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if (g, "i", i) not in used and (g, "j", j) not in used:
            used |= {(g, "i", i), (g, "j", j)}
            want.add((g, i, j, s))
    assert got == want


def grid(pair, side, index, rows):
    return [(pair, side, index, r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)]


CELLS = "pair_id string, side string, table_index int, row int, col int, text string"


@pytest.mark.parametrize(
    "one,two,cells,counts",
    [
        ([["K", "A", "B"], ["x", "1", "2"], ["y", "3", "4"]], [["K", "B", "A"], ["y", "4", "3"], ["x", "2", "9"]], {(1, 1, "x", "A", "1", "9")}, (0, 0, 0, 0)),
        ([["K", "A"], ["x", "1"], ["y", "3"]], [["K", "A", "C"], ["x", "1", "5"], ["z", "3", "6"]], set(), (1, 1, 0, 1)),
        ([["K", "A"], ["", "1"], ["", "3"]], [["K", "A"], ["", "1"], ["", "4"], ["", "5"]], {(2, 1, "row 3", "A", "3", "4")}, (0, 1, 0, 0)),
        ([["", ""], ["x", "1"]], [["", "", ""], ["x", "2", "q"]], {(1, 1, "x", "", "1", "2")}, (0, 0, 0, 1)),
        ([["K", "A"], ["x", "Two  Words"]], [["K", "A"], ["X", "two words"]], set(), (0, 0, 0, 0)),
    ],
)
def test_tables(spark, one, two, cells, counts):
    df = spark.createDataFrame(grid("P", "original", 0, one) + grid("P", "revised", 1, two), CELLS)
    pairs = spark.createDataFrame([("P", 0, 1), ("P", 5, None), ("P", None, 7)], "pair_id string, original_index int, revised_index int")
    changes, summary = B.compare_tables(df, pairs)
    assert {tuple(r)[3:] for r in changes.collect()} == cells
    s = {(r["original_index"], r["revised_index"]): r for r in summary.collect()}
    assert tuple(s[0, 1][c] for c in ("rows_removed", "rows_added", "columns_removed", "columns_added")) == counts
    assert s[5, None]["kind"] == "removed" and s[None, 7]["kind"] == "added" and s[5, None]["place"] == 10_005
    assert s[0, 1]["kind"] == ("modified" if cells or any(counts) else "unchanged")


def test_table_pairs_and_references(spark):
    a, b, c = [["K", "alpha beta"], ["x", "gamma"]], [["Q", "delta"], ["y", "kappa"]], [["Z", "omega"]]
    cells = spark.createDataFrame(grid("P", "original", 0, a) + grid("P", "original", 1, b) + grid("P", "revised", 0, c) + grid("P", "revised", 1, b) + grid("P", "revised", 2, a), CELLS)
    t = cells.select("pair_id", "side", "table_index").distinct().selectExpr("*", "cast(null as string) caption", "cast(null as string) label", "'S0' section_id")
    got = {tuple(r)[1:] for r in B.pair_tables(cells, t).collect()}
    assert got == {(0, 2), (1, 1), (None, 0)}
    refs = [("original", 0, "Doe J. Old results of a study (2018)."), ("original", 1, "Roe K. Another work on things (2011)."), ("revised", 0, "Roe K. Another work on things (2012)."), ("revised", 1, "Poe L. Fresh text (2024)."), ("revised", 2, "Doe J. Old results of a study (2018).")]
    df = spark.createDataFrame([("P", *r) for r in refs], "pair_id string, side string, index int, raw string")
    out = {(r["kind"], r["original"], r["revised"], r["year"]) for r in B.compare_references(df).collect()}
    assert out == {("same", 0, 2, 2018), ("modified", 1, 0, 2012), ("added", None, 1, 2024)}
