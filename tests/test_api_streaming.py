"""Entry points on files, and operators on streams."""

import pytest
from pyspark.sql import functions as F

from quirewise import api
from quirewise.__main__ import main
from quirewise.operators import facts as A
from quirewise.operators import requests as Q
from quirewise.streaming import arrivals as S
from test_sources import BODY, COMMENTS, GOOD, package


@pytest.fixture
def files(tmp_path):
    o, v = tmp_path / "o.docx", tmp_path / "v.docx"
    o.write_bytes(package(BODY, comments=COMMENTS))
    v.write_bytes(package(BODY.replace("Front matter", "Front matter grows").replace(">3<", ">4<")))
    return str(o), str(v)


def test_compare_and_guard(spark, files):
    c = api.compare_documents(spark, [("A", *files)])
    assert {x["kind"]: x["n"] for x in c.paragraphs.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"unchanged": 6, "modified": 1}
    assert [tuple(x)[5:] for x in c.cells.collect()] == [("a\nb", "N", "3", "4")]
    assert c.tables.first()["kind"] == "modified" and c.references.first()["kind"] == "same" and c.summary.first()["paragraphs_modified"] == 1
    assert {x["status"] for x in api.guard_revision(spark, [("A", *files)], ("front matter",)).collect()} == {"PROTECTED_INTACT", "NUMBERS_CHANGED", "TABLE_CHANGED"}


def test_extract(spark, files, tmp_path):
    assert [x["id"] for x in api.extract_issues(spark, files[0], "comments").collect()] == ["RT-001", "RT-002"]
    (tmp_path / "i.yml").write_text(GOOD)
    assert {x["category"] for x in api.extract_issues(spark, str(tmp_path / "i.yml"), "issues").collect()} == {"CORRECT", "ADD"}
    (tmp_path / "r.md").write_text("1. Fix this.\n2. Please add that.")
    assert [x["category"] for x in api.extract_issues(spark, str(tmp_path / "r.md")).orderBy("id").collect()] == ["CORRECT", "ADD"]
    with pytest.raises(ValueError):
        api.extract_issues(spark, "x", "other")


def test_command_line(spark, files, capsys):
    assert main(["diff", *files]) == 0 and "modified" in capsys.readouterr().out
    assert main(["guard", *files, "--fail-on-flag"]) == 3
    assert main(["comments", files[0]]) == 0 and "Explain." in capsys.readouterr().out
    assert main(["diff", "missing.docx", files[1]]) == 1


def test_similar_issues(spark):
    rows = [("P", "a", "Please define the scale used in the second table of results", "x", "ADD"), ("P", "b", "Please define the scale used in the second table of the results", "", "ADD"), ("P", "c", "Define scale used in second table results now", "x", "ADD"), ("P", "d", "", "x", "ADD"), ("Q", "a", "Please define the scale used in the second table of results", "x", "ADD"), ("P", "e", "Quite another request altogether", "x", "ADD")]
    df = spark.createDataFrame(rows, "pair_id string, id string, comment_text string, anchor_text string, category string")
    from quirewise.functions import text as T

    got = {(x["pair_id"], x["id_a"], x["id_b"]) for x in Q.similar_issues(df).collect()}
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1] and x[2] and y[2]:
                s = T.token_ratio(x[2], y[2])
                if s >= 0.85 or (x[3] and x[3:] == y[3:] and s >= 0.6):
                    want.add((x[0], x[1], y[1]))
    assert got == want and ("P", "a", "b") in got


def test_facts(spark):
    req = spark.createDataFrame([("P", "1", ["scal", "tabl"]), ("P", "2", ["fish"])], "pair_id string, issue_id string, terms array<string>")
    units = spark.createDataFrame([("P", "1", "S2", "The scales in a table"), ("P", "1", "S3", "a scale"), ("P", "2", "S3", "nothing")], "pair_id string, issue_id string, section_id string, unit string")
    targets = spark.createDataFrame([("P", "1", "S1"), ("P", "2", "S1")], "pair_id string, issue_id string, section_id string")
    assert {tuple(x) for x in A.term_coverage(req, units).collect()} == {("P", "1", 2, 2, 2), ("P", "2", 1, 0, 0)}
    assert {tuple(x) for x in A.elsewhere(req, units, targets).collect()} == {("P", "1")}
    d = spark.createDataFrame([("P", "original", "Twice."), ("P", "original", "twice. "), ("P", "revised", "Twice."), ("P", "original", "")], "pair_id string, side string, text string")
    assert [tuple(x)[2:] for x in A.duplicate_groups(d).collect()] == [(2, 1)]
    asked = spark.createDataFrame([("P", "1", 2, 2015, None), ("P", "2", None, None, None)], "pair_id string, issue_id string, min_count int, since_year int, until_year int")
    refs = spark.createDataFrame([("P", "added", 2016), ("P", "added", 2010), ("P", "added", None), ("P", "same", 2020)], "pair_id string, kind string, year int")
    assert [tuple(x) for x in A.reference_facts(asked, refs).collect()] == [("P", "1", 2, 1)]
    said = Q.parse_request(spark.createDataFrame([("P", "1", "It should be 396, not 384."), ("P", "2", 'replace "old word" with "new word"')], "pair_id string, issue_id string, t string"), "t")
    texts = spark.createDataFrame([("P", "1", "original", 1, "384 and 3840"), ("P", "1", "revised", 1, "396 only"), ("P", "2", "original", 1, "Old word, old words"), ("P", "2", "revised", 1, "new word")], "pair_id string, issue_id string, side string, number int, text string")
    assert {tuple(x)[1:] for x in A.value_facts(said, texts).collect()} == {("1", 1, 0, 0, 1), ("2", 1, 0, 0, 1)}


def test_streams(spark, tmp_path):
    rows = [(1, "LDN", "2020-08-11 07:06", "2020-09-01 00:00:00"), (2, "LDN", "x", "2020-09-02 00:00:00"), (1, "LDN", "2020-08-11 07:06", "2020-09-03 00:00:00")]
    df = spark.createDataFrame(rows, "key long, office string, date string, at string").withColumn("loaded_at", F.to_timestamp("at")).drop("at")
    df.write.parquet(str(tmp_path / "in"))
    offices = spark.createDataFrame([("LDN", "Europe/London", "DMY")], "office string, tz string, date_order string")
    s = S.read_arrivals(spark, str(tmp_path / "in"), "key long, office string, date string, loaded_at timestamp")
    q = S.append_to(S.utc_arrivals(S.once_each(s, "key"), offices), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {x["key"]: x["utc"] for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "2020-08-11T06:06:00.000000Z", 2: "invalid"} and spark.read.parquet(str(tmp_path / "out")).count() == 2
    c = S.classified_arrivals(S.read_arrivals(spark, str(tmp_path / "in"), "comment_text string"))
    assert c.isStreaming and "category" in c.columns
