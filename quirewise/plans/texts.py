"""Queries of the text layer over paragraphs, documents and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.sources.tables import records, table


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "paragraphs", "text", "is_heading")


def f_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """F1, F25."""
    return _paragraphs(spark, folder).select("para_id", T.normalize(F.col("text")).alias("norm"), T.squash(F.col("text")).alias("squashed"))


def f_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """F2, F3, F7."""
    t = F.col("text")
    return _paragraphs(spark, folder).select("para_id", F.array_join(T.tokens(t), "|").alias("tokens"), T.word_count(t).alias("words"), F.array_join(T.token_set(t), "|").alias("token_set"))


def f_stems(spark: SparkSession, folder: str) -> DataFrame:
    """F11-F13."""
    t = F.col("text")
    return _paragraphs(spark, folder).select("para_id", F.array_join(T.content_terms(t), "|").alias("terms"), F.array_join(T.stems_in(t), "|").alias("stems"))


def f_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """F8."""
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ord", "sentence"))


def f_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """F9, F10, F20."""
    t = F.col("text")
    return _paragraphs(spark, folder).select("para_id", F.array_join(T.numbers_in(t), "|").alias("numbers"), T.contains_number(t, "2013").alias("n_2013"), T.parse_year(t).alias("year"))


def f_headings(spark: SparkSession, folder: str) -> DataFrame:
    """F18, F19."""
    t = F.col("text")
    p = _paragraphs(spark, folder).select("para_id", "is_heading", T.heading_parts(t).alias("h"), T.caption_info(t).alias("c"))
    return p.select("para_id", "is_heading", F.col("h.number").alias("number"), F.col("h.title").alias("title"), F.col("c.kind").alias("caption_kind"), F.col("c.number").alias("caption_number"), F.col("c.title").alias("caption_title"))


def f_render(spark: SparkSession, folder: str) -> DataFrame:
    """F14, F15, F22, F27, F28."""
    t = F.col("text")
    return _paragraphs(spark, folder).select(
        "para_id", T.truncate(t, 60).alias("short"), T.strip_control(t).alias("bare"), T.word_key(t).alias("key"), T.clean_inline(t).alias("inline"), T.md_escape(t).alias("escaped"), T.safe_cell(t).alias("safe")
    )


def f_quoted_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """F26, over requests that quote their anchor."""
    i = records(spark, folder, "issues", "comment_text", "anchor_text")
    said = F.concat(F.col("comment_text"), F.lit(' See "'), F.col("anchor_text"), F.lit('" and "two words".'))
    return i.select("issue_key", T.quoted_anchor(said).alias("anchor"))


def f_location_label(spark: SparkSession, folder: str) -> DataFrame:
    """F23, over revisions."""
    t = records(spark, folder, "tracked", "section_id", "table_index", "cell", "paragraph", "story")
    c = F.col
    label = T.location_label(c("section_id"), c("table_index"), c("cell.row"), c("cell.col"), c("paragraph"), c("paragraph") + 1, F.when(c("story") != "body", F.concat(F.lit("in "), c("story"))))
    return t.select("tracked_key", label.alias("label"))


def f_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Each original paragraph with the revised one of the same number."""
    p = records(spark, folder, "paragraphs", "pair_id", "side", "number", "text")
    o = p.filter("side = 'original'").select("pair_id", "number", F.col("text").alias("a"))
    r = p.filter("side = 'revised'").select("pair_id", "number", F.col("text").alias("b"))
    d = T.diff_words(F.col("a"), F.col("b"))
    j = o.join(r, ["pair_id", "number"]).select("pair_id", "number", "a", "b", d.alias("d"))
    return j.select(
        "pair_id", "number", F.round(T.similarity(F.col("a"), F.col("b")), 3).alias("similarity"), F.round(T.char_similarity(F.col("a"), F.col("b")), 3).alias("char_similarity"), F.array_join("d.added", " ").alias("added"), F.array_join("d.removed", " ").alias("removed"), F.size(T.added_sentences(F.col("a"), F.col("b"))).alias("new_sentences")
    )


QUERIES = {f.__name__: f for f in (f_normalize, f_tokens, f_stems, f_sentences, f_numbers, f_headings, f_render, f_quoted_anchor, f_location_label, f_similarity)}

_P = "SELECT DISTINCT para_id, text, is_heading FROM paragraphs"
_W = r"[\p{L}\p{N}]+(?:[''.\-][\p{L}\p{N}]+)*"
_WS = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(c: str) -> str:
    t = f"regexp_replace(translate({c}, '‘’“”–—‑ ​­', '''''\"\"--- '), '{_WS}', ' ', 'g')"
    return f"lower(trim({t}))"


def _stem(w: str) -> str:
    cases = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + 3} THEN left({w}, length({w}) - {len(s)}) || '{r}'" for s, r in T.SUFFIXES)
    return f"(CASE WHEN length({w}) <= 3 THEN {w} ELSE regexp_replace(CASE {cases} ELSE {w} END, '^(.{{4,}})e$', '\\1') END)"


_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS)) + "]"
_DULL = "[" + ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS | T.FILLER)) + "]"
_NUM = r"(^|[^\p{L}\p{N}_.])(-?\d[\d,]*(?:\.\d+)?%?)"

SQL = {
    "f_normalize": f"SELECT para_id, {_norm('text')} AS norm, lower(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS squashed FROM ({_P})",
    "f_tokens": f"""
WITH t AS (SELECT para_id, regexp_extract_all({_norm("text")}, '{_W}') AS w, len(regexp_extract_all(text, '{_W}')) AS n FROM ({_P}))
SELECT para_id, array_to_string(w, '|') AS tokens, CAST(n AS INTEGER) AS words, array_to_string(list_sort(list_filter(list_distinct(w), lambda x: NOT list_contains({_STOP}, x))), '|') AS token_set FROM t""",
    "f_stems": f"""
WITH t AS (SELECT para_id, regexp_extract_all({_norm("text")}, '{_W}') AS w FROM ({_P})),
s AS (SELECT para_id, list_transform(w, lambda x: {_stem("x")}) AS a,
  list_transform(list_filter(w, lambda x: NOT list_contains({_DULL}, x) AND NOT regexp_full_match(x, '\\p{{Nd}}+') AND length(x) >= 3), lambda x: {_stem("x")}) AS b FROM t)
SELECT para_id, array_to_string({_FIRST.format("b")}, '|') AS terms, array_to_string({_FIRST.format("a")}, '|') AS stems FROM s""",
    "f_sentences": r"""
WITH m AS (SELECT doc_id, replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, 'et al.', 'et al~'), 'e.g.', 'e.g~'), 'i.e.', 'i.e~'), 'Fig.', 'Fig~'), 'Dr.', 'Dr~'), 'vs.', 'vs~'), 'No.', 'No~'),
    '([.!?])\s+', '\1§', 'g'), '~', '.') AS t FROM documents),
k AS (SELECT doc_id, string_split(regexp_replace(t, '§([A-Z0-9"''(\[])', '¦\1', 'g'), '¦') AS l, t FROM m),
o AS (SELECT doc_id, text FROM documents)
SELECT k.doc_id, CAST(i - 1 AS INTEGER) AS ord,
  trim(substr(o.text, CAST(1 + coalesce(list_sum(list_transform(l[:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT), length(l[i])), ' ' || chr(10)) AS sentence
FROM k JOIN o USING (doc_id), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE l[i] <> ''
""",
    "f_numbers": f"""
SELECT para_id, array_to_string(list_transform(regexp_extract_all(replace(text, '%', '% '), '{_NUM}', 2), lambda x: replace(x, ',', '')), '|') AS numbers,
  CAST(len(list_filter(regexp_extract_all(replace(text, '%', '% '), '{_NUM}', 2), lambda x: replace(x, ',', '') = '2013')) AS INTEGER) AS n_2013,
  CAST(coalesce(nullif(regexp_extract(text, '\\(\\s*((?:19|20)\\d{{2}})[a-z]?\\s*\\)', 1), ''), nullif(regexp_extract(text, '(?:^|[^\\p{{L}}\\p{{N}}_])((?:19|20)\\d{{2}})[a-z]?(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '')) AS INTEGER) AS year
FROM ({_P})""",
    "f_headings": rf"""
WITH p AS (SELECT para_id, is_heading, text, regexp_replace(text, '^{_WS}|{_WS}$', '', 'g') AS t FROM ({_P})),
c AS (SELECT *, regexp_matches(t, '(?i)^\s*(table|tab\.|figure|fig\.)\s*([A-Za-z]?\d+(?:[.\-]\d+)*)\b[.:)]?\s*(.*)$') AS cap, regexp_matches(text, '^\s*(\d+(?:\.\d+)*)[.)]?\s+(\S.*)$') AS num FROM p)
SELECT para_id, is_heading, CASE WHEN num THEN regexp_extract(text, '^\s*(\d+(?:\.\d+)*)[.)]?\s+(\S.*)$', 1) END AS number,
  CASE WHEN num THEN regexp_replace(regexp_extract(text, '^\s*(\d+(?:\.\d+)*)[.)]?\s+(\S.*)$', 2), '{_WS}$', '') ELSE t END AS title,
  CASE WHEN cap THEN CASE WHEN lower(t) LIKE 'tab%' THEN 'table' ELSE 'figure' END END AS caption_kind,
  CASE WHEN cap THEN regexp_extract(t, '(?i)^\s*(table|tab\.|figure|fig\.)\s*([A-Za-z]?\d+(?:[.\-]\d+)*)\b[.:)]?\s*(.*)$', 2) END AS caption_number,
  CASE WHEN cap THEN regexp_extract(t, '(?i)^\s*(table|tab\.|figure|fig\.)\s*([A-Za-z]?\d+(?:[.\-]\d+)*)\b[.:)]?\s*(.*)$', 3) END AS caption_title FROM c""",
    "f_render": rf"""
WITH p AS (SELECT para_id, text, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS q, {_norm("text")} AS n FROM ({_P}))
SELECT para_id, CASE WHEN length(q) <= 60 THEN q ELSE rtrim(left(q, 59)) || '…' END AS short, regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f]', '', 'g') AS bare,
  regexp_replace(n, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS key,
  trim(regexp_replace(regexp_replace(text, '\*\*|__|`', '', 'g'), '{_WS}', ' ', 'g')) AS inline,
  regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<', '&lt;'), '>', '&gt;'), '[', '\['), ']', '\]'), '|', '\|'), '`', '\`'), '[ \t]+', ' ', 'g') AS escaped,
  CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS safe FROM p""",
    "f_quoted_anchor": rf"""
WITH i AS (SELECT DISTINCT issue_key, comment_text || ' See "' || anchor_text || '" and "two words".' AS s FROM issues),
q AS (SELECT issue_key, list_filter(list_transform(regexp_extract_all(s, '["“]([^"”]{{8,600}})["”]', 1), lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')), lambda x: len(regexp_split_to_array(x, '{_WS}')) >= 3) AS l FROM i)
SELECT issue_key, coalesce(list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1], '') AS anchor FROM q""",
    "f_location_label": """
SELECT DISTINCT tracked_key, coalesce(nullif(concat_ws(', ', CASE WHEN section_id <> '' THEN section_id END, 'Table #' || (table_index + 1), CASE WHEN table_index IS NOT NULL THEN 'cell R' || ("cell"."row" + 1) || 'C' || ("cell".col + 1) END,
  'paragraphs ' || paragraph || '–' || (paragraph + 1), CASE WHEN story <> 'body' THEN 'in ' || story END), ''), 'unlocated') AS label FROM tracked""",
}
