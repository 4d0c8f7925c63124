"""People that compare() accepts share a block, however large it is; what Jaro-Winkler and the initials decide."""

import random
import string

from quirewise.llm import names
from quirewise.llm.blocks import block_pairs


def test_every_accepted_pair_of_people_meets():
    rng = random.Random(5)
    surnames = ["li", "ooi", "lee", "aeiou", "smith", "varnybini", "ou yang", "q" * 65, "ab" * 35]
    given = ["bob", "robert", "ann", "margaret", "peggy", "will", "zoe"]

    def slip(w):
        k, c = rng.randrange(len(w)), rng.choice(string.ascii_lowercase)
        return rng.choice((w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]))

    def form(s, g):
        s, g = (slip(x) if len(x) > 2 and rng.random() < 0.3 else x for x in (s, g))
        return rng.choice((f"p|{s}|{g}|{g[0]}", f"p|{s}||{g[0]}", f"u|{g}|{s}|", f"u|{s}|{g}|k"))

    accepted = 0
    for _ in range(6000):
        s, g = rng.choice(surnames), rng.choice(given)
        a, b = form(s, g), form(s, rng.choice(given) if rng.random() < 0.3 else g)
        if a != b and names.compare(a, b) is not None:
            accepted += 1
            assert set(names.block_keys(a)) & set(names.block_keys(b)), (a, b)
    assert accepted > 1000


def test_initials_that_spell_a_title():
    assert names.parse_name("Vostaulmay, D.R.") == "p|vostaulmay||dr"
    assert names.parse_name("Vostaulmay MS") == "p|vostaulmay||ms"
    assert names.parse_name("Dr. Ann Lee") == "u|ann|lee|" and names.parse_name("DR Lee, Ann") == "p|lee|ann|a"


def test_slip_in_a_word_of_three_letters():
    a, b = (names.parse_name(x) for x in ("Floronteau Institute of Labour Laaw", "Floronteau Institute of Labour Law"))
    assert names.compare(a, b) == 1
    assert names.compare("p|kolbaver||r", "p|kolboavere|robert|r") is None  # Jaro-Winkler 0.96, two slips


def test_hot_block_is_split(spark):
    rows = spark.createDataFrame([("hot", f"n{k:03d}") for k in range(100)] + [("hot", "n000"), ("cold", "n001"), ("cold", "n000"), (None, "n003"), (None, "n004")], "key string, form string")
    got = [tuple(r) for r in block_pairs(rows, "key", "form", block=16).collect()]
    want = {(f"n{a:03d}", f"n{b:03d}") for a in range(100) for b in range(a + 1, 100)}
    assert len(got) == len(set(got)) and set(got) == want
    assert block_pairs(rows.limit(0), "key", "form").count() == 0
