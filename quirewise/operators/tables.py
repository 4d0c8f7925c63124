"""Pairing and comparison of tables, and of reference lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators.assign import blocked_theta, greedy_pairs
from quirewise.session import cut

# When tables and references match.
CAPTION, CONTENT, SAME_SECTION, REFERENCE = 0.8, 0.5, 0.1, 0.6


def pair_tables(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """pair_id, original_index, revised_index: which tables are the same one.

    `tables` has pair_id, side, table_index, caption, label, section_id (the last three
    may be null). Labels that are unique on both sides pair first; the rest pairs by
    likeness of captions or of the words in the first three rows, best first, a little
    more within one section. Tables left over have a null on the other side.
    """
    top = cells.filter(F.col("row") < 3).select("pair_id", "side", "table_index", F.explode(T.token_set(F.coalesce("text", F.lit("")))).alias("w"))
    bags = top.groupBy("pair_id", "side", "table_index").agg(F.array_sort(F.collect_set("w")).alias("bag"))
    t = tables.join(bags, ["pair_id", "side", "table_index"], "left").withColumn("bag", F.coalesce("bag", F.expr("cast(array() as array<string>)")))
    t = cut(t)
    of = lambda side, p: t.filter(F.col("side") == side).select("pair_id", *[F.col(c).alias(p + c) for c in ("table_index", "caption", "label", "section_id", "bag")])
    o, r = of("original", "o_"), of("revised", "r_")
    once = lambda df, c: df.filter(F.length(c) > 0).groupBy("pair_id", F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(c.replace("label", "table_index")).alias(c.replace("label", "table_index"))).filter("n = 1").drop("n")
    named = cut(once(o, "o_label").join(once(r, "r_label"), ["pair_id", "label"]).select("pair_id", "o_table_index", "r_table_index"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in a.itertuples(index=False):
            bag = set(x.o_bag)
            for y in b.itertuples(index=False):
                caption = T.char_ratio(x.o_caption, y.r_caption) if x.o_caption and y.r_caption else 0.0
                other = set(y.r_bag)
                content = len(bag & other) / len(bag | other) if bag and other else float(not bag and not other)
                if caption >= CAPTION or content >= CONTENT:
                    out.append((x.pair_id, x.o_table_index, y.r_table_index, max(caption, content) + SAME_SECTION * (x.o_section_id == y.r_section_id)))
        return pd.DataFrame(out, columns=["pair_id", "o_table_index", "r_table_index", "score"])

    left = o.join(named, ["pair_id", "o_table_index"], "left_anti")
    right = r.join(named, ["pair_id", "r_table_index"], "left_anti")
    cand = blocked_theta(left, right, ["pair_id"], near, "pair_id string, o_table_index int, r_table_index int, score double", block=128)
    best = greedy_pairs(cand, ["pair_id"], "o_table_index", "r_table_index", [-F.col("score"), F.col("o_table_index"), F.col("r_table_index")])
    both = cut(named.unionByName(best.drop("score")))
    none = F.lit(None).cast("int")
    gone = o.join(both, ["pair_id", "o_table_index"], "left_anti").select("pair_id", "o_table_index", none.alias("r_table_index"))
    new = r.join(both, ["pair_id", "r_table_index"], "left_anti").select("pair_id", none.alias("o_table_index"), "r_table_index")
    return both.unionByName(gone).unionByName(new).select("pair_id", F.col("o_table_index").alias("original_index"), F.col("r_table_index").alias("revised_index"))


def compare_tables(cells: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cell changes, and one row of counts for each table of `pairs`.

    Columns match by header name if both sides have names and at most one header of the
    original is blank, else by place. Rows match by their first cell if those are
    filled and unique on both sides, else by place. A cell outside a ragged row is
    empty. Values are compared in normalised form. Kinds of tables: unchanged,
    modified, removed, added; `place` orders the tables of a pair.
    """
    at = ["pair_id", "original_index", "revised_index"]
    both = pairs.filter("original_index is not null and revised_index is not null")
    text = F.coalesce("text", F.lit(""))

    def of(side: str, key: str) -> DataFrame:
        mine = cells.filter(F.col("side") == side).select("pair_id", F.col("table_index").alias(key), "row", "col", text.alias("text"), T.normalize(text).alias("norm"))
        return mine.join(both, ["pair_id", key])

    o, r = of("original", "original_index"), of("revised", "revised_index")

    def heads(df: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        h = df.filter("row = 0")
        names = h.filter("norm <> ''").groupBy(*at, F.col("norm").alias("name")).agg(F.max("col").alias(f"{p}c"))
        facts = h.groupBy(*at).agg((F.max("col") + 1).alias(f"{p}_width"), F.count_distinct(F.when(F.col("norm") != "", F.col("norm"))).alias(f"{p}_names"))
        return names, facts

    o_names, o_facts = heads(o, "o")
    r_names, r_facts = heads(r, "r")

    def keys(df: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        rows = df.filter("row > 0").groupBy(*at, "row").agg(F.coalesce(F.max(F.when(F.col("col") == 0, F.col("norm"))), F.lit("")).alias("key"), F.coalesce(F.max(F.when(F.col("col") == 0, F.col("text"))), F.lit("")).alias("label"))
        facts = rows.groupBy(*at).agg(((F.count(F.lit(1)) == F.count_distinct("key")) & (F.min(F.length("key")) > 0)).alias(f"{p}_keyed"), F.max("row").alias(f"{p}_rows"))
        return rows, facts

    o_rows, o_kfacts = keys(o, "o")
    r_rows, r_kfacts = keys(r, "r")
    facts = both
    for extra in (o_facts, r_facts, o_kfacts, r_kfacts):
        facts = facts.join(extra, at, "left")
    facts = cut(
        facts.na.fill(0, ["o_width", "r_width", "o_names", "r_names", "o_rows", "r_rows"])
        .na.fill(True, ["o_keyed", "r_keyed"])
        .withColumn("by_name", (F.col("o_names") > 0) & (F.col("r_names") > 0) & (F.col("o_names") >= F.greatest(F.lit(1), F.col("o_width") - 1)))
        .withColumn("by_key", F.col("o_keyed") & F.col("r_keyed"))
    )
    named = facts.filter("by_name").select(*at)
    placed = facts.filter("not by_name").select(*at, F.least("o_width", "r_width").alias("w")).filter("w > 0")
    columns = o_names.join(r_names, [*at, "name"]).join(named, at, "left_semi").select(*at, "oc", "rc").unionByName(placed.select(*at, F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("oc")).withColumn("rc", F.col("oc")))
    keyed = facts.filter("by_key").select(*at)
    unkeyed = facts.filter("not by_key").select(*at)
    o_by_key = o_rows.select(*at, F.col("row").alias("orow"), "key", "label")
    r_by_key = r_rows.select(*at, F.col("row").alias("rrow"), "key")
    rows = (
        o_by_key.join(r_by_key, [*at, "key"]).join(keyed, at, "left_semi").select(*at, "orow", "rrow")
        .unionByName(o_rows.select(*at, "row").join(r_rows.select(*at, "row"), [*at, "row"]).join(unkeyed, at, "left_semi").select(*at, F.col("row").alias("orow"), F.col("row").alias("rrow")))
        .unionByName(facts.select(*at, F.lit(0).alias("orow"), F.lit(0).alias("rrow")))
    )
    grid = rows.join(columns, at)
    oc = o.select(*at, F.col("row").alias("orow"), F.col("col").alias("oc"), F.col("text").alias("original"))
    rc = r.select(*at, F.col("row").alias("rrow"), F.col("col").alias("rc"), F.col("text").alias("revised"))
    first = o.filter("col = 0").select(*at, F.col("row").alias("orow"), F.when(F.col("norm") != "", F.col("text")).alias("first"))
    header = o.filter("row = 0").select(*at, F.col("col").alias("oc"), F.col("text").alias("head"))
    differ = (
        grid.join(oc, [*at, "orow", "oc"], "left").join(rc, [*at, "rrow", "rc"], "left")
        .na.fill("", ["original", "revised"])
        .filter(T.normalize(F.col("original")) != T.normalize(F.col("revised")))
    )
    changes = (
        differ.join(first, [*at, "orow"], "left").join(header, [*at, "oc"], "left")
        .select(*at, F.col("orow").alias("row"), F.col("oc").alias("col"), F.coalesce("first", F.concat(F.lit("row "), (F.col("orow") + 1).cast("string"))).alias("row_label"), F.coalesce("head", F.concat(F.lit("column "), (F.col("oc") + 1).cast("string"))).alias("col_label"), "original", "revised")
    )
    changes = cut(changes)

    def only(a: DataFrame, b: DataFrame, flag: DataFrame, key: str, out: str) -> DataFrame:
        return a.join(flag, at, "left_semi").join(b.select(*at, key), [*at, key], "left_anti").groupBy(*at).agg(F.count(F.lit(1)).alias(out))

    heads_of = lambda df: df.filter("row = 0 and norm <> ''").select(*at, F.col("norm").alias("name"))
    counts = facts
    for part in (
        changes.groupBy(*at).agg(F.count(F.lit(1)).alias("cells_changed")),
        only(o_rows, r_rows, keyed, "key", "k_removed"), only(r_rows, o_rows, keyed, "key", "k_added"),
        only(heads_of(o), r_names, named, "name", "n_removed"), only(heads_of(r), o_names, named, "name", "n_added"),
    ):
        counts = counts.join(part, at, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    past = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0)).cast("int")
    paired = counts.select(
        *at,
        F.when(F.col("by_key"), zero("k_removed")).otherwise(past("o_rows", "r_rows")).alias("rows_removed"), F.when(F.col("by_key"), zero("k_added")).otherwise(past("r_rows", "o_rows")).alias("rows_added"),
        F.when(F.col("by_name"), zero("n_removed")).otherwise(past("o_width", "r_width")).alias("columns_removed"), F.when(F.col("by_name"), zero("n_added")).otherwise(past("r_width", "o_width")).alias("columns_added"),
        zero("cells_changed").alias("cells_changed"),
    )
    quiet = F.col("rows_removed") + F.col("rows_added") + F.col("columns_removed") + F.col("columns_added") + F.col("cells_changed") == 0
    paired = paired.withColumn("kind", F.when(quiet, "unchanged").otherwise("modified"))
    alone = pairs.filter("original_index is null or revised_index is null").select(*at, *[F.lit(0).alias(c) for c in ("rows_removed", "rows_added", "columns_removed", "columns_added", "cells_changed")], F.when(F.col("revised_index").isNull(), "removed").otherwise("added").alias("kind"))
    summary = paired.unionByName(alone).withColumn("place", F.coalesce("revised_index", F.lit(10_000) + F.col("original_index")))
    return changes, summary


def describe_table_change() -> Column:
    """In words: what changed in a table, from the columns of the summary."""
    part = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}")))
    said = F.concat_ws(", ", part("rows_added", "rows more"), part("rows_removed", "rows less"), part("columns_added", "columns more"), part("columns_removed", "columns less"), part("cells_changed", "cells changed"))
    return F.when(said == "", F.col("kind")).otherwise(said)


def compare_references(refs: DataFrame) -> DataFrame:
    """pair_id, kind, original, revised, original_raw, revised_raw, year: changes of the reference lists.

    `refs` has pair_id, side, index, raw. Equal entries pair in order, the rest by
    similarity, best first (ties to the largest indexes). Kinds: same, modified, removed,
    added; year is that of the revised entry, or of a removed one.
    """
    nth = Window.partitionBy("pair_id", "side", "norm").orderBy("index")
    x = cut(refs.withColumn("norm", T.normalize(F.col("raw"))).withColumn("k", F.row_number().over(nth)))
    of = lambda side, p: x.filter(F.col("side") == side).select("pair_id", "norm", "k", F.col("index").alias(p), F.col("raw").alias(f"{p}_raw"))
    o, r = of("original", "original"), of("revised", "revised")
    same = cut(o.join(r, ["pair_id", "norm", "k"]).select("pair_id", F.lit("same").alias("kind"), "original", "revised"))
    left = o.join(same, ["pair_id", "original"], "left_anti").select("pair_id", "original", "original_raw")
    right = r.join(same, ["pair_id", "revised"], "left_anti").select("pair_id", "revised", "revised_raw")

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [(x.pair_id, x.original, y.revised, s) for x in a.itertuples(index=False) for y in b.itertuples(index=False) if (s := T.token_ratio(x.original_raw, y.revised_raw)) >= REFERENCE]
        return pd.DataFrame(out, columns=["pair_id", "original", "revised", "s"])

    cand = blocked_theta(left, right, ["pair_id"], near, "pair_id string, original int, revised int, s double")
    modified = greedy_pairs(cand, ["pair_id"], "original", "revised", [-F.col("s"), -F.col("original"), -F.col("revised")]).select("pair_id", F.lit("modified").alias("kind"), "original", "revised")
    both = cut(same.unionByName(modified))
    none = F.lit(None).cast("int")
    gone = o.join(both, ["pair_id", "original"], "left_anti").select("pair_id", F.lit("removed").alias("kind"), "original", none.alias("revised"))
    new = r.join(both, ["pair_id", "revised"], "left_anti").select("pair_id", F.lit("added").alias("kind"), none.alias("original"), "revised")
    found = both.unionByName(gone).unionByName(new).join(o.select("pair_id", "original", "original_raw"), ["pair_id", "original"], "left").join(r.select("pair_id", "revised", "revised_raw"), ["pair_id", "revised"], "left")
    return found.select("pair_id", "kind", "original", "revised", "original_raw", "revised_raw", T.parse_year(F.coalesce("revised_raw", "original_raw")).alias("year"))
