"""Queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm import lookalike, mixing, names, nearcopies, packing, spans, tokens
from quirewise.llm.blocks import block_pairs
from quirewise.session import cut
from quirewise.sources.tables import records, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings of one person or organisation among reviewers and authors."""
    said = table(spark, folder, "issues").select(F.col("reviewer").alias("name")).unionByName(table(spark, folder, "tracked").select(F.col("author").alias("name")))
    return names.name_pairs(names.name_entities(said))


def p1_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling among reviewers and authors with the entity it names."""
    said = table(spark, folder, "issues").select(F.col("reviewer").alias("name")).unionByName(table(spark, folder, "tracked").select(F.col("author").alias("name")))
    return names.name_entities(said)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that look unchanged, and anchors found only by their look."""
    p = records(spark, folder, "paragraphs", "pair_id", "side", "text").select(F.col("para_id").alias("id"), F.col("pair_id").alias("grp"), "side", F.col("text").alias("raw"), lookalike.canonical(F.col("text")).alias("form"))
    p = cut(p.withColumn("form", F.when(F.col("form") != F.col("raw"), F.col("form")))).withColumn("form", F.coalesce("form", "raw"))
    original, revised = p.filter("side = 'original'").drop("side"), p.filter("side = 'revised'").drop("side")
    anchors = records(spark, folder, "issues", "pair_id", "anchor_text").filter("anchor_text <> ''")
    needles = anchors.select(F.col("issue_key").alias("id"), F.col("pair_id").alias("grp"), F.col("anchor_text").alias("raw"), lookalike.canonical(F.col("anchor_text")).alias("form"))
    same = lookalike.same_look(original, revised).select(F.lit("paragraph").alias("kind"), F.least("left_id", "right_id").alias("id_a"), F.greatest("left_id", "right_id").alias("id_b"))
    found = lookalike.find_stretches(needles, original).select(F.lit("anchor").alias("kind"), F.col("needle_id").alias("id_a"), F.col("text_id").alias("id_b"))
    return same.unionByName(found)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Near-identical requests, and requests wrongly listed as duplicates."""
    issues = cut(records(spark, folder, "issues", "pair_id", "id", "comment_text", "possible_duplicates"))
    members, links = nearcopies.near_copies(issues, "issue_key", "comment_text", k=3, num=1, den=2, least_words=8)
    a = members.select(F.col("issue_key").alias("x"), F.col("cls").alias("a"))
    b = members.select(F.col("issue_key").alias("y"), F.col("cls").alias("b"))
    # The table's form asks for all pairs, of copies too; a text that many requests share is split.
    copies = block_pairs(members, "cls", "issue_key", one_key=True).select(F.col("a").alias("x"), F.col("b").alias("y"))
    similar = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    close = copies.unionByName(similar).withColumn("close", F.lit(True))
    said = issues.select(F.col("issue_key").alias("from"), "pair_id", F.explode("possible_duplicates").alias("id")).distinct()
    named = said.join(issues.select("pair_id", "id", F.col("issue_key").alias("to")), ["pair_id", "id"]).filter("from <> to")
    named = named.select(F.least("from", "to").alias("x"), F.greatest("from", "to").alias("y")).distinct()
    keys = members.select("issue_key")
    named = named.join(keys.withColumnRenamed("issue_key", "x"), "x", "left_semi").join(keys.withColumnRenamed("issue_key", "y"), "y", "left_semi").withColumn("listed", F.lit(True))
    kind = F.when(F.col("close") & F.col("listed"), "listed").when(F.col("close"), "unlisted").otherwise("wrong")
    return close.join(named, ["x", "y"], "full_outer").select(F.col("x").alias("issue_a"), F.col("y").alias("issue_b"), kind.alias("kind"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each request of at least eight words with its class, group and number of links."""
    issues = records(spark, folder, "issues", "comment_text")
    members, links = nearcopies.near_copies(issues, "issue_key", "comment_text", k=3, num=1, den=2, least_words=8)
    return nearcopies.near_groups(members, cut(links), "issue_key")


def _sized(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents with their size in tokens, counted once."""
    return cut(table(spark, folder, "documents").select("doc_id", *columns, tokens.n_tokens(F.col("text")).alias("n_tokens")))


def p6_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The pack of every piece of every document, with the fill of the pack, for each capacity."""
    return packing.pack(_sized(spark, folder), table(spark, folder, "pack_sizes"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents chosen to meet the target shares, with their copies."""
    return mixing.mix(_sized(spark, folder, "source"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix(_sized(spark, folder, "source"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of word positions that stand in 40 or more consecutive words found in another document."""
    return spans.shared_spans(table(spark, folder, "documents"))


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document is shared."""
    docs = table(spark, folder, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p3_found, p4_found, p4_groups, p6_packs, p7_mix, p7_shares, p8_found, p8_share)}

_LATIN = "aeopcyxijshdqwlvyABEKMHOPCTXSIJYYGVQWocjABEZHIKMNOPTYXCJ--"
_OTHER = "аеорсухіјѕһԁԛԝӏѵүАВЕКМНОРСТХЅІЈУҮԌѴԚԜοϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ‐‑"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _sql_look(c: str) -> str:
    """The look of a text in DuckDB, for the characters the tables hold."""
    blanks = "[\u00a0\u2000-\u200a\u202f\u205f\u3000\\t\\n\\r]"
    hidden = "[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]"
    t = f"regexp_replace(regexp_replace({c}, '{hidden}', '', 'g'), '{blanks}', ' ', 'g')"
    t = f"translate(translate({t}, '{_WIDE}', '{_NARROW}'), '{_OTHER}', '{_LATIN}')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("µ", "μ")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"nfc_normalize({t})"


SQL: dict[str, str] = {
    "p3_found": f"""
WITH p AS (SELECT DISTINCT para_id, pair_id, side, text, {_sql_look("text")} AS form FROM paragraphs),
i AS (SELECT DISTINCT issue_key, pair_id, anchor_text, {_sql_look("anchor_text")} AS form FROM issues WHERE anchor_text <> '')
SELECT 'paragraph' AS kind, least(a.para_id, b.para_id) AS id_a, greatest(a.para_id, b.para_id) AS id_b
FROM p a JOIN p b ON a.pair_id = b.pair_id AND a.form = b.form AND a.side = 'original' AND b.side = 'revised' AND a.text <> b.text
UNION ALL
SELECT 'anchor', issue_key, para_id FROM i JOIN p ON i.pair_id = p.pair_id AND p.side = 'original' AND contains(p.form, i.form) AND NOT contains(p.text, i.anchor_text)
""",
    "p4_found": r"""
WITH i AS (SELECT DISTINCT issue_key, pair_id, id, possible_duplicates, regexp_extract_all(lower(comment_text), '[\p{L}\p{N}]+') AS w FROM issues),
s AS (SELECT issue_key, pair_id, id, possible_duplicates, list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) AS sh FROM i WHERE len(w) >= 8),
t AS (SELECT issue_key, unnest(sh) AS g, len(sh) AS n FROM s),
c AS (SELECT a.issue_key AS x, b.issue_key AS y FROM t a JOIN t b ON a.g = b.g AND a.issue_key < b.issue_key
  GROUP BY a.issue_key, b.issue_key HAVING 2 * count(*) >= any_value(a.n) + any_value(b.n) - count(*)),
d AS (SELECT DISTINCT least(a.issue_key, b.issue_key) AS x, greatest(a.issue_key, b.issue_key) AS y
  FROM (SELECT issue_key, pair_id, unnest(possible_duplicates) AS o FROM s) a JOIN s b ON a.pair_id = b.pair_id AND a.o = b.id AND a.issue_key <> b.issue_key)
SELECT coalesce(c.x, d.x) AS issue_a, coalesce(c.y, d.y) AS issue_b, CASE WHEN c.x IS NULL THEN 'wrong' WHEN d.x IS NULL THEN 'unlisted' ELSE 'listed' END AS kind
FROM c FULL JOIN d ON c.x = d.x AND c.y = d.y
""",
    "p4_groups": r"""
WITH RECURSIVE i AS (SELECT DISTINCT issue_key, regexp_extract_all(lower(comment_text), '[\p{L}\p{N}]+') AS w FROM issues),
s AS (SELECT issue_key, list_sort(list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)])) AS sh FROM i WHERE len(w) >= 8),
m AS (SELECT issue_key, sh, min(issue_key) OVER (PARTITION BY sh) AS cls FROM s),
t AS (SELECT issue_key AS cls, unnest(sh) AS g, len(sh) AS n FROM m WHERE issue_key = cls),
l AS (SELECT a.cls AS a, b.cls AS b FROM t a JOIN t b ON a.g = b.g AND a.cls <> b.cls GROUP BY ALL HAVING 2 * count(*) >= any_value(a.n) + any_value(b.n) - count(*)),
w AS (SELECT DISTINCT cls AS node, cls AS met FROM m UNION SELECT w.node, l.b FROM w JOIN l ON l.a = w.met)
SELECT m.issue_key, m.cls, g.grp, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links FROM m JOIN (SELECT node, min(met) AS grp FROM w GROUP BY node) g ON g.node = m.cls LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = m.cls
""",
    "p8_found": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 39)) AS i, w FROM w WHERE len(w) >= 40),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 40], ' ')) AS h FROM g),
s AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS a, max(doc_id) OVER (PARTITION BY h) AS b FROM h) WHERE a <> b),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 40 THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
found AS (SELECT doc_id, min(i) AS start_word, max(i) + 40 - min(i) AS n_words FROM r GROUP BY doc_id, k)
SELECT doc_id, start_word, n_words FROM found
""",
    "p8_share": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 39)) AS i, w FROM w WHERE len(w) >= 40),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 40], ' ')) AS h FROM g),
s AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS a, max(doc_id) OVER (PARTITION BY h) AS b FROM h) WHERE a <> b),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 40 THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
found AS (SELECT doc_id, min(i) AS start_word, max(i) + 40 - min(i) AS n_words FROM r GROUP BY doc_id, k)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, CASE WHEN len(w.w) > 0 THEN coalesce(n, 0) / len(w.w) ELSE 0 END AS share
FROM w LEFT JOIN (SELECT doc_id, sum(n_words) AS n FROM found GROUP BY doc_id) f ON f.doc_id = w.doc_id
""",
}
