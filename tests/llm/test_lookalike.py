import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewise.llm import lookalike
from quirewise.llm.lookalike import look

ALPHABET = "ab ééеｅﬁ  ​­Å̧한한\U0001d41a."


def plain_look(text):
    """Brute force: the whole text at once."""
    own = lookalike.looks()
    t = "".join(own._ordinary(c) for c in text)
    t = "".join(lookalike.CONFUSABLE.get(x, x) for x in unicodedata.normalize("NFD", t))
    return unicodedata.normalize("NFC", t)


def test_every_composition():
    """Each character that decomposes to two, also where the second is no combining mark, reads as its decomposition does."""
    own = lookalike.looks()
    pairs = [(chr(p), unicodedata.normalize("NFD", chr(p))) for p in range(0x20000) if unicodedata.decomposition(chr(p))[:1] not in ("", "<")]
    assert len(pairs) > 900 and not [c for c, d in pairs if own.look(f"x {c} y") != own.look(f"x {d} y")]
    for c in ("\u09cb", "\u0b4b", "\u0bca", "\u0cc7", "\u0d4a", "\u1026", "\u1b06"):
        assert look(c) == look(unicodedata.normalize("NFD", c)) == c


def test_unicode_confusables(spark):
    pairs = lookalike.confusable_pairs(spark)
    own = lookalike.looks(pairs)
    assert len(pairs) > 400 and own.look("\u0251\u0261 \u1d04\u0585 \u216c\u03bd\u03c1 \u13a0") == "ag co Lvp D"
    assert own.look("\u0410\u0430 \u0406\u0456") == "Aa Ii" and own.look("a\u3164b\u115fc") == "abc" and own.look("a\u2800b") == "a b"
    assert own.look("\u2013 \u2019 \u00e9 \u0416") == "\u2013 \u2019 \u00e9 \u0416"
    for text in ("\u03ac\u0301x", "\u0251\u0301", "\u0430\u0308\u200b\u0301"):
        assert own.look(own.look(text)) == own.look(text)


@given(st.text(ALPHABET, max_size=40))
@settings(max_examples=300, deadline=None)
def test_splicing_equals_the_whole(text):
    assert look(text) == plain_look(text)
    assert look(look(text)) == look(text)


def test_examples():
    assert look("ｇｏｖｅｒｎｅｄ сlаss­room ​café ﬁn") == "governed classroom café fin"
    assert look("a  b") == "a  b"
    assert look("Case, É!") == "Case, É!"
    assert look("") == ""


def test_stretches_against_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta"]
    texts, needles = [], []
    for i in range(120):
        texts.append((i, f"g{i % 3}", " ".join(rng.choices(words, k=rng.randint(1, 40)))))
    dirty = lambda s: "".join({"a": "а", "e": "е", " ": " "}.get(c, c) if rng.random() < 0.2 else c for c in s)
    for i in range(150):
        t = rng.choice(texts)
        n = rng.choice([1, 2, 3, 10, 20, 60, 120])
        at = rng.randrange(max(1, len(t[2]) - n))
        needles.append((i, t[1], dirty(t[2][at : at + n])))
    texts = [(i, g, dirty(t) if rng.random() < 0.5 else t) for i, g, t in texts] + [(900, "g0", None), (901, "g0", ""), (902, None, "alpha"), (903, "g1", "alpha " * 20_000)]
    needles += [(900, "g0", None), (901, "g0", ""), (902, "g0", "zzz"), (903, None, "alpha")]
    make = lambda rows: spark.createDataFrame(rows, "id long, grp string, raw string").withColumn("form", lookalike.canonical(F.col("raw"))).withColumn("fp", F.lit(1))
    got = {(r[0], r[1]) for r in lookalike.find_stretches(make(needles), make(texts)).collect()}
    look = lookalike.looks(lookalike.confusable_pairs(spark)).look
    want = {(n[0], t[0]) for n in needles for t in texts if n[2] and t[2] and n[1] == t[1] and n[1] and look(n[2]) in look(t[2]) and n[2] not in t[2]}
    assert got == want and want
    same = {tuple(r) for r in lookalike.same_look(make(texts), make(needles)).collect()}
    assert same == {(t[0], n[0]) for t in texts for n in needles if t[2] is not None and n[2] is not None and t[1] and t[1] == n[1] and look(t[2]) == look(n[2]) and t[2] != n[2]}


def test_empty(spark):
    none = spark.createDataFrame([], "id long, grp string, raw string, form string")
    assert lookalike.find_stretches(none, none).count() == 0
    assert lookalike.same_look(none, none).count() == 0
