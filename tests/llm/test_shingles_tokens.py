import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirewise.llm.shingles import grams, sliding_min, winnowed
from quirewise.llm.tokens import VOCABULARY, _counts, token_count


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 13))
@settings(max_examples=80, deadline=None)
def test_grams_name_runs(items, k):
    g = grams(np.array(items, dtype=np.uint64), k)
    runs = [tuple(items[i : i + k]) for i in range(len(items) - k + 1)]
    assert len(g) == len(runs)
    assert len(set(g.tolist())) == len(set(runs)) == len(set(zip(runs, g.tolist())))


@given(st.lists(st.integers(0, 99), max_size=50), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_sliding_min(items, w):
    a = np.array(items, dtype=np.uint64)
    assert sliding_min(a, w).tolist() == [min(items[i : i + w]) for i in range(len(items) - w + 1)]


@given(st.text("abc ", min_size=8, max_size=40), st.text("abc ", max_size=30), st.text("abc ", max_size=30))
@settings(max_examples=60, deadline=None)
def test_every_print_of_a_needle_is_in_its_text(needle, before, after):
    k, w = 4, 5
    _, prints = winnowed([needle], k, w)
    which, held = winnowed(["", before + needle + after], k, w)
    assert set(prints.tolist()) <= set(held[which == 1].tolist())


@given(st.text(st.sampled_from("ab 'sl1.,\n\t é \x1c　-"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_counts_equal_the_tokenizer(text):
    assert token_count(text) == len(_counts(VOCABULARY).encoding.encode_ordinary(text))
