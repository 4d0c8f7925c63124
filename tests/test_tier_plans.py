"""Lookups of many tiers settle each tier by itself: what is left to plan at the end joins nothing."""

from quirewise.operators import facts as A
from quirewise.operators import locate as L
from quirewise.operators import requests as Q
from quirewise.operators import revision as R


def documents(spark):
    rows = [("P", side, 1, "1 Study area", True, 1, "S1") for side in ("original", "revised")]
    rows += [("P", "original", 2, "The river was sampled in spring by hand.", False, None, "S1"), ("P", "revised", 2, "The river was sampled in spring and autumn by hand.", False, None, "S1")]
    return spark.createDataFrame(rows, "pair_id string, side string, number int, text string, is_heading boolean, heading_level int, section_id string")


def requests(spark):
    rows = [("P", "1", "Please explain this.", "sampled in spring", None), ("P", "2", "Please expand section 1.", "", None), ("P", "3", "Good.", "", None)]
    x = spark.createDataFrame(rows, "pair_id string, issue_id string, comment_text string, anchor_text string, section_id string")
    return Q.parse_request(x.selectExpr("*", "cast(null as int) paragraph_start", "cast(null as int) paragraph_end", "cast(null as int) table_index"), "comment_text")


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_targets(spark):
    p = documents(spark)
    got = L.locate_targets(requests(spark), p, R.section_tree(p))
    assert joins(got) == 0
    assert {(x["issue_id"], x["tier"], x["section_id"]) for x in got.collect()} == {("1", "C", "S1"), ("2", "E", "S1")}


def test_tracked_evidence(spark):
    x = spark.createDataFrame([("P", "1", ["spr"]), ("P", "2", ["autumn"])], "pair_id string, issue_id string, terms array<string>")
    scopes = spark.createDataFrame([("P", "1", "S1")], "pair_id string, issue_id string, in_section string")
    tracked = spark.createDataFrame([("P", "revised", "S1", 4, "insertion", "body", "in spring and autumn")], "pair_id string, side string, section_id string, ord int, kind string, story string, text string")
    got = A.tracked_evidence(x, scopes, x.filter("issue_id = '2'").select("pair_id", "issue_id"), tracked)
    assert joins(got) == 0
    assert {tuple(r) for r in got.collect()} == {("P", "1", 1, 4, "in spring and autumn"), ("P", "2", 1, 4, "in spring and autumn")}


def test_values_in_the_place(spark):
    x = Q.parse_request(spark.createDataFrame([("P", "1", "It should be 396, not 384.")], "pair_id string, issue_id string, comment_text string"), "comment_text")
    texts = spark.createDataFrame([("P", "1", "original", 1, "384 fish"), ("P", "1", "revised", 1, "396 fish")], "pair_id string, issue_id string, side string, number int, text string")
    got = A.value_facts(x, texts)
    assert joins(got) == 0
    assert [tuple(r) for r in got.collect()] == [("P", "1", 1, 0, 0, 1)]


def test_changes_meet_requests_without_texts(spark):
    rows = [("P", 1, 1, "modified", True, "One fish.", "One fish. Two new herrings swim.", "Two new herrings swim."), ("P", None, 2, "added", False, None, "A new end.", "A new end."), ("P", 3, None, "removed", False, "Gone.", None, "")]
    d = spark.createDataFrame(rows, "pair_id string, original int, revised int, kind string, text_changed boolean, original_text string, revised_text string, added_text string")
    got = L.measured_units(d)
    assert "revised_text" not in got.columns and {x["kind"]: x["unit_words"] for x in got.collect()} == {"modified": 4, "added": 3, "removed": None}
    assert [tuple(x) for x in L.scope_counts(got, ["pair_id"]).collect()] == [("P", 1, 1, 1, 0, 2, 7)] == [tuple(x) for x in L.scope_counts(d, ["pair_id"]).collect()]
