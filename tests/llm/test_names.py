import itertools

import pytest

from quirewise.llm import names
from quirewise.llm.components import connected_components

PEOPLE = [
    ["Björn Glastotova", "Björn  Glastotova ", "Bjorn Glastotova", "björn glastotova", "Glastotova, Björn", "GLASTOTOVA, Björn", "BjörnGlastotova", "bglastotova", "B. Glastotova", "Glastotova B.", "Glastotova BK", "Prof. Glastotova, Björn K.", "Böjrn Glastotova", "Glastotova Björn"],
    ["Elizabeth Mesturdave", "Liz Mesturdave", "Elizabeth Meturdave", "E. Mesturdave", "Elizabeth Mesturdave (external)", "elizabeth_mesturdave"],
    ["Andrew Mesturdave", "Andy Mesturdave", "A. Mesturdave"],
    ["Heskoasay University of School Policy", "HESKOASAY UNIVERSITY OF SCHOOL POLICY", "Univ. of School Policy (Heskoasay)", "University of School Policy, Heskoasay", "The Heskoasay University of School Policy", "Hieskoasay University of School Policy", "Heskoasay School Policy University", "Heskoasay University of Scho. Policy", "Univ. f. School Policy Heskoasay"],
    ["Heskoasay University of Plant Breeding"],
    ["Tolveserg XE", "X. E. Tolveserg"],
]
ROLES = ["Reviewer 1", "Reviewer #2", "R3", "Client", "Handling editor", "Anonymous", "Examiner", "", "  ", "---", None]


def test_entities(spark):
    rows = [(n, "clash") for group in PEOPLE for n in group * 2] + [(r, "clash") for r in ROLES]
    df = spark.createDataFrame(rows, "name string, form string")
    got = {(r["name_a"], r["name_b"]) for r in names.name_pairs(names.name_entities(df)).collect()}
    want = {tuple(sorted(p)) for group in PEOPLE for p in itertools.combinations(group, 2)}
    assert got == want


def test_initials_that_fit_two_people_link_nobody(spark):
    df = spark.createDataFrame([("Anna Vellandorf",), ("Albert Vellandorf",), ("A. Vellandorf",)], "name string")
    assert names.name_pairs(names.name_entities(df)).count() == 0


def test_empty_and_long(spark):
    assert names.name_entities(spark.createDataFrame([], "name string")).count() == 0
    long = spark.createDataFrame([("x" * 50_000,), ("Ann " * 5_000,)], "name string")
    assert names.name_entities(long).count() == 2
    rng = __import__("random").Random(1)
    base = "Ann " + "".join(rng.choices("bdfgklmnprstaeiou", k=40_000)).capitalize()
    rows = [(base,), (base[:20_000] + "q" + base[20_000:],), (base[:-3] + "x" + base[-2:],), (base[:30] + base[31:],)]
    assert names.name_pairs(names.name_entities(spark.createDataFrame(rows, "name string"))).count() == 6


@pytest.mark.parametrize("n", [10, 59, 60, 61, 69, 70, 71, 90])
def test_near_codes_meet(n):
    rng = __import__("random").Random(n)
    code = "".join(rng.choices("0123456789", k=n))
    for i in range(n):
        for other in (code[:i] + code[i + 1 :], code[:i] + "x" + code[i:], code[:i] + "x" + code[i + 1 :], code[:i] + code[i + 1 : i + 2] + code[i] + code[i + 2 :]):
            assert names._near_codes(code) & names._near_codes(other)


@pytest.mark.parametrize("a,b", [("glastotova", "glamtotova"), ("elizabeth", "elizbaeth"), ("kernygini", "kerngini"), ("marek", "mareek"), ("jostph", "joseph")])
def test_one_edit_shares_a_block(a, b):
    assert names.one_edit(a, b)
    keys = lambda w: set(names.block_keys(f"p|{w}|nora|n"))
    assert keys(a) & keys(b)


def test_jaro_winkler_known_values():
    assert round(names.jaro_winkler("martha", "marhta"), 3) == 0.961
    assert round(names.jaro_winkler("dixon", "dicksonx"), 3) == 0.813
    assert names.jaro_winkler("", "a") == 0.0


def test_components_against_union_find(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5), (7777, 7777), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(up)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
