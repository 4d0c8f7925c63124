"""Requests meet counts and totals of sections, not texts or changes, and get what they got from these."""

from quirewise.operators import facts as A
from quirewise.operators import locate as L
from quirewise.operators import requests as Q
from quirewise.operators import revision as R


def documents(spark):
    row = lambda side, n, text, level, section: ("P", side, n, text, level is not None, level, section)
    rows = []
    for side, value, word in (("original", "384", "tin"), ("revised", "396", "zinc")):
        rows += [row(side, 1, "1 Area", 1, "S1"), row(side, 2, f"{value} fish in {word}, {value} in tins.", None, "S1"), row(side, 3, "1.1 Part", 2, "S2"), row(side, 4, f"Here {word} and {value}.", None, "S2"), row(side, 5, "2 End", 1, "S3"), row(side, 6, f"No {word}.", None, "S3")]
    rows += [row("original", 7, "3 Old", 1, "S4"), row("original", 8, "384 gone.", None, "S4")]
    return spark.createDataFrame(rows, "pair_id string, side string, number int, text string, is_heading boolean, heading_level int, section_id string")


def parts(spark):
    p = documents(spark)
    s = R.section_tree(p)
    m = spark.createDataFrame([("P", "S1", "S1"), ("P", "S2", "S2"), ("P", "S3", "S3"), ("P", "S4", None)], "pair_id string, original_id string, revised_id string")
    t = spark.createDataFrame([("P", "1", "S1"), ("P", "2", "S2"), ("P", "3", "S3"), ("P", "4", "S4"), ("P", "5", "S0"), ("P", "6", None)], "pair_id string, issue_id string, section_id string")
    return p, s, m, t


def test_values_by_section(spark):
    p, s, m, t = parts(spark)
    said = ["It should be 396, not 384.", 'Replace "tin" with "zinc".', "It should be 396, not 384.", "It should be 396, not 384.", "It should be 396, not 384.", 'Replace "tin" with "zinc".']
    x = Q.parse_request(spark.createDataFrame([("P", str(k), c) for k, c in enumerate(said, 1)], "pair_id string, issue_id string, comment_text string"), "comment_text")
    tree = R.ancestors(s)
    want = sorted(A.value_facts(x, A.scope_texts(t, p, m, tree)).collect())
    counts = A.value_counts(A._asked(x), p, ("section_id",))
    got = A.place_value_facts(x, A.scope_sections(t, m, tree), p, counts)
    assert sorted(got.select(*A.value_facts(x, A.scope_texts(t, p, m, tree)).columns).collect()) == want
    assert [tuple(r)[1:] for r in want] == [("1", 3, 0, 0, 3), ("2", 1, 0, 0, 1), ("3", 0, 0, 0, 0), ("4", 1, 0, 0, 0)]
    assert [tuple(r)[2:] for r in A.whole_value_facts(x.filter("issue_id = '6'"), p, counts).collect()] == [(3, 0, 0, 3)]


def test_changes_by_section(spark):
    p, s, m, t = parts(spark)
    rows = [("P", 2, 2, "modified", False, "S1", "S1", 4), ("P", 4, 4, "unchanged", False, "S2", "S2", None), ("P", None, 6, "added", False, None, "S3", 3), ("P", 6, None, "removed", False, "S3", None, None), ("P", 8, None, "removed", False, "S4", None, None), ("P", 7, 5, "moved", False, "S4", "S3", None), ("P", 1, 1, "modified", True, "S1", "S1", 2)]
    d = spark.createDataFrame(rows, "pair_id string, original int, revised int, kind string, is_heading boolean, original_section_id string, revised_section_id string, unit_words int")
    want = L.scope_counts(L.scope_changes(t, d, m, s), ["pair_id", "issue_id"])
    got = L.scope_totals(t, d, m, s)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert {r["issue_id"] for r in want.collect()} == {"1", "2", "3", "4"}


def test_insertions_move_without_their_texts(spark):
    said = [("P", "revised", "S1", k, "insertion", "body", f"spring and autumn {k}") for k in range(6)] + [("P", "revised", "S2", 9, "insertion", "body", "spring")]
    tracked = spark.createDataFrame(said, "pair_id string, side string, section_id string, ord int, kind string, story string, text string")
    x = spark.createDataFrame([("P", "1", ["autumn", "none"]), ("P", "2", ["autumn", "spring"])], "pair_id string, issue_id string, terms array<string>")
    scopes = spark.createDataFrame([("P", "1", "S1"), ("P", "1", "S9")], "pair_id string, issue_id string, in_section string")
    got = A.tracked_evidence(x, scopes, x.filter("issue_id = '2'").select("pair_id", "issue_id"), tracked)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(i, k + 1, k, f"spring and autumn {k}") for i in ("1", "2") for k in range(3)]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
