"""Organisations that compare() accepts share a block."""

import random

from quirewise.llm import names


def meet(a, b):
    return bool(set(names.block_keys(a)) & set(names.block_keys(b)))


def test_two_words():
    forms = [names.parse_name(x) for x in ("Northern Science Institute", "Northen Science Institute", "Inst. of Northern Sci.")]
    assert all(f[0] == "o" for f in forms)
    for other in forms[1:]:
        assert names.compare(forms[0], other) is not None and meet(forms[0], other)


def test_every_accepted_pair_meets():
    rng = random.Random(3)
    base = ["northern", "science", "applied", "nursing", "oceanic", "aeio", "physics", "law"]

    def slip(w):
        k, c = rng.randrange(len(w)), rng.choice("abdeklmnorst")
        return rng.choice((w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]))

    accepted = 0
    for _ in range(4000):
        words = rng.sample(base, rng.randint(1, 4))
        sides = []
        for _ in range(2):
            said = [w[: rng.randint(2, 4)] + "." if rng.random() < 0.3 else slip(w) if rng.random() < 0.3 else w for w in words]
            rng.shuffle(said)
            sides.append("o|inst|" + " ".join(said))
        a, b = sides
        if a != b and names.compare(a, b) is not None:
            accepted += 1
            assert meet(a, b), (a, b)
    assert accepted > 300
    assert len(names.block_keys("o|inst|" + " ".join(["word", "other"] * 5000))) < 50
