"""Counted facts on which a decision about a request rests: values, terms, references and structure, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.functions import text as T
from quirewise.operators.locate import find_texts
from quirewise.session import cut, kept


def scope_texts(targets: DataFrame, paragraphs: DataFrame, matches: DataFrame, tree: DataFrame) -> DataFrame:
    """pair_id, issue_id, side, number, text: the paragraphs in the place of each located request, on both sides."""
    return scope_sections(targets, matches, tree).join(paragraphs.select("pair_id", "side", "section_id", "number", "text"), ["pair_id", "side", "section_id"]).select("pair_id", "issue_id", "side", "number", "text")


def scope_sections(targets: DataFrame, matches: DataFrame, tree: DataFrame) -> DataFrame:
    """pair_id, issue_id, side, section_id: the sections in the place of each located request, on both sides."""
    t = targets.filter("section_id is not null").select("pair_id", "issue_id", "section_id").join(matches.select("pair_id", F.col("original_id").alias("section_id"), "revised_id"), ["pair_id", "section_id"], "left")
    ids = F.array(F.struct(F.lit("original").alias("side"), F.col("section_id").alias("ancestor_id")), F.struct(F.lit("revised").alias("side"), F.col("revised_id").alias("ancestor_id")))
    return t.select("pair_id", "issue_id", F.inline(ids)).filter("ancestor_id is not null").join(tree, ["pair_id", "side", "ancestor_id"]).select("pair_id", "issue_id", "side", "section_id")


def _asked(requests: DataFrame) -> DataFrame:
    """pair_id, issue_id, is_number, old, new of the requests that name a value."""
    pair = F.coalesce(F.col("numeric_correction"), F.col("replace_pair"))
    return requests.filter("numeric_correction is not null or replace_pair is not null").select("pair_id", "issue_id", F.col("numeric_correction").isNotNull().alias("is_number"), T.normalize(pair["old"]).alias("old"), T.normalize(pair["new"]).alias("new"))


def _whole(text: str, value: Column) -> Column:
    """How often a value stands in a text as whole words."""
    return F.regexp_count(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), value, F.lit(r"\E(?![\p{L}\p{N}_])")))


def value_facts(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """pair_id, issue_id, old_before, old_after, new_before, new_after: how often the old and the new value stand in the place.

    `requests` has replace_pair and numeric_correction of parse_request. Numbers count as
    whole numbers, other wording as whole words in normalised text; a number goes first.
    """
    j = _asked(requests).join(texts, ["pair_id", "issue_id"]).withColumns({"n": T.numbers_in(F.col("text")), "t": T.normalize(F.col("text"))})
    count = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), 0).when(F.col("is_number"), F.size(F.filter("n", lambda y: y == F.col(c)))).otherwise(_whole("t", F.col(c)))
    at = lambda c, side: F.sum(F.when(F.col("side") == side, count(c)).otherwise(0))
    return cut(j.groupBy("pair_id", "issue_id").agg(at("old", "original").alias("old_before"), at("old", "revised").alias("old_after"), at("new", "original").alias("new_before"), at("new", "revised").alias("new_after")))


def value_counts(asked: DataFrame, paragraphs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pair_id, is_number, v, side, the columns `by` and c: how often each value asked for stands there, where it does.

    Every value is counted once for each pair, side and place, not once for each request;
    numbers meet by equality, other wording through find_texts. `asked` is that of _asked.
    """
    v = kept(asked.select("pair_id", "is_number", F.explode(F.array("old", "new")).alias("v")).filter("v <> ''").distinct())
    keys = ["pair_id", "is_number", "v", "side", *by]
    said = paragraphs.select("pair_id", "side", *by, F.explode(T.numbers_in(F.col("text"))).alias("v"))
    counted = kept(v.filter("is_number").join(said, ["pair_id", "v"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("c")))
    wording = v.filter("not is_number").select("pair_id", F.col("v").alias("needle_id"), F.col("v").alias("norm"))
    for side in ("original", "revised"):
        p = paragraphs.filter(F.col("side") == side).join(wording.select("pair_id").distinct(), "pair_id", "left_semi")
        p = kept(p.select("pair_id", "number", *by, T.normalize(F.col("text")).alias("norm"), T.tokens(F.col("text")).alias("words")))
        hit = find_texts(wording, p).join(p.select("pair_id", "number", *by, "norm"), ["pair_id", "number"])
        hit = hit.select("pair_id", F.lit(False).alias("is_number"), F.col("needle_id").alias("v"), F.lit(side).alias("side"), *by, _whole("norm", F.col("needle_id")).alias("c"))
        counted = counted.unionByName(kept(hit.groupBy(*keys).agg(F.sum("c").alias("c"))))
    return counted


def _before_after(counts: DataFrame, keys: list[str]) -> DataFrame:
    at = lambda side: F.sum(F.when(F.col("side") == side, F.col("c")).otherwise(0))
    return counts.groupBy(*keys).agg(at("original").alias("before"), at("revised").alias("after"))


def whole_value_facts(requests: DataFrame, paragraphs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """What value_facts gives for requests whose place is the whole document. `counts` is that of value_counts, by any columns."""
    x = kept(_asked(requests))
    totals = cut(_before_after(value_counts(x, paragraphs) if counts is None else counts, ["pair_id", "is_number", "v"]))
    for c in ("old", "new"):
        x = x.join(totals.select("pair_id", "is_number", F.col("v").alias(c), F.col("before").alias(f"{c}_before"), F.col("after").alias(f"{c}_after")), ["pair_id", "is_number", c], "left")
    return x.select("pair_id", "issue_id", "old_before", "old_after", "new_before", "new_after").na.fill(0)


def place_value_facts(requests: DataFrame, places: DataFrame, paragraphs: DataFrame, counts: DataFrame) -> DataFrame:
    """What value_facts gives for requests with a place, of counts by section instead of texts that move with each request.

    `places` is that of scope_sections, `counts` that of value_counts by section_id.
    Places without any paragraph give no row.
    """
    x, spot = kept(_asked(requests)), ["pair_id", "side", "section_id"]
    places = kept(places.join(paragraphs.select(*spot).distinct(), spot, "left_semi"))
    keys = ["pair_id", "issue_id"]
    out = x.join(places.select(*keys).distinct(), keys, "left_semi").select(*keys)
    wants = x.select(*keys, "is_number", F.inline(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("v")) for c in ("old", "new")]))).filter("v <> ''")
    hit = kept(_before_after(wants.join(places, keys).join(counts, [*spot, "is_number", "v"]), [*keys, "which"]))
    for c in ("old", "new"):
        out = out.join(hit.filter(F.col("which") == c).select(*keys, F.col("before").alias(f"{c}_before"), F.col("after").alias(f"{c}_after")), keys, "left")
    return cut(out.na.fill(0))


def term_coverage(requests: DataFrame, units: DataFrame) -> DataFrame:
    """pair_id, issue_id, n_terms, covered, best: terms of a request found in all new text, and most in one unit.

    `requests` has pair_id, issue_id, terms; `units` pair_id, issue_id, unit.
    """
    x = requests.filter(F.size("terms") > 0).select("pair_id", "issue_id", "terms")
    u = units.select("pair_id", "issue_id", T.stems_in(F.col("unit")).alias("stems")).join(x, ["pair_id", "issue_id"]).withColumn("hit", F.array_intersect("terms", "stems"))
    best = u.groupBy("pair_id", "issue_id").agg(F.max(F.size("hit")).alias("best"))
    found = u.select("pair_id", "issue_id", F.explode("hit").alias("w")).groupBy("pair_id", "issue_id").agg(F.count_distinct("w").alias("covered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return x.select("pair_id", "issue_id", F.size("terms").alias("n_terms")).join(best, ["pair_id", "issue_id"], "left").join(found, ["pair_id", "issue_id"], "left").select("pair_id", "issue_id", "n_terms", zero("covered"), zero("best"))


def reference_facts(requests: DataFrame, references: DataFrame) -> DataFrame:
    """pair_id, issue_id, need, qualifying: new references that meet the years asked for, against the number asked for.

    `requests` has min_count, since_year, until_year; only those with a count or a first
    year are kept. `references` is the result of compare_references.
    """
    x = requests.filter("min_count is not null or since_year is not null").select("pair_id", "issue_id", F.coalesce("min_count", F.lit(1)).alias("need"), "since_year", "until_year")
    new = references.filter("kind = 'added'").select("pair_id", "year")
    fit = (F.col("since_year").isNull() | (F.col("year") >= F.col("since_year"))) & (F.col("until_year").isNull() | (F.col("year") <= F.col("until_year")))
    return x.join(new, "pair_id", "left").groupBy("pair_id", "issue_id", "need").agg(F.count_if(fit & F.col("year").isNotNull()).alias("qualifying"))


def tracked_evidence(requests: DataFrame, scopes: DataFrame, anywhere: DataFrame, tracked: DataFrame, most: int = 3) -> DataFrame:
    """pair_id, issue_id, n, ord, text: the first tracked insertions in the place of a request that share a term with it.

    Insertions in the body of the revised side count. `scopes` has pair_id, issue_id,
    in_section (a revised section of the place), `anywhere` the requests whose place is
    the whole document. The first insertions of a request are among the first ones of
    each of its terms, so only those meet requests.
    """
    from pyspark.sql import Window

    first = lambda df, *keys: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).filter(F.col("n") <= most).drop("n")
    # Texts move once at the start and once with what is found; in between a number stands for each.
    told = kept(tracked.filter("kind = 'insertion' and side = 'revised' and story = 'body'").select("pair_id", F.col("section_id").alias("in_section"), "ord", "text", F.xxhash64("text").alias("h"), F.array_distinct(T.stems_in(F.col("text"))).alias("stems")))
    t = kept(told.select("pair_id", "in_section", "ord", "h", F.explode("stems").alias("stem")))
    keys = ["pair_id", "issue_id"]
    # Terms that no insertion of the pair has, and sections without any, lead nowhere.
    terms = requests.select(*keys, F.explode(F.array_distinct("terms")).alias("stem"))
    terms = kept(terms.join(t.select("pair_id", "stem").distinct(), ["pair_id", "stem"], "left_semi"))
    scopes = scopes.select(*keys, "in_section").join(told.select("pair_id", "in_section").distinct(), ["pair_id", "in_section"], "left_semi")
    located = terms.join(kept(scopes), keys).join(first(t, "pair_id", "in_section", "stem"), ["pair_id", "in_section", "stem"])
    whole = terms.join(anywhere.select(*keys), keys).join(first(t, "pair_id", "stem"), ["pair_id", "stem"])
    hit = kept(located.select(*keys, "ord", "h").distinct()).unionByName(kept(whole.select(*keys, "ord", "h").distinct())).distinct()
    hit = kept(hit.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).filter(F.col("n") <= most))
    texts = told.select("pair_id", "ord", "h", "text").dropDuplicates(["pair_id", "ord", "h"])
    return cut(hit.join(texts, ["pair_id", "ord", "h"]).select(*keys, "n", "ord", "text"))


def elsewhere(requests: DataFrame, units: DataFrame, targets: DataFrame) -> DataFrame:
    """pair_id, issue_id: located requests whose terms all stand in one piece of new text outside their section.

    `units` has pair_id, section_id, unit. Requests meet pieces through their first term.
    """
    x = requests.filter(F.size("terms") > 0).join(targets.select("pair_id", "issue_id", F.col("section_id").alias("home")), ["pair_id", "issue_id"]).select("pair_id", "issue_id", "terms", "home", F.element_at("terms", 1).alias("stem"))
    u = units.select("pair_id", "section_id", T.stems_in(F.col("unit")).alias("stems")).withColumn("stem", F.explode("stems"))
    hit = x.join(u, ["pair_id", "stem"]).filter(~F.col("home").eqNullSafe(F.col("section_id")) & (F.size(F.array_except("terms", "stems")) == 0))
    return hit.select("pair_id", "issue_id").distinct()


def duplicate_groups(paragraphs: DataFrame) -> DataFrame:
    """pair_id, norm_id, before, after: texts that stand twice or more in the original, with how often in the revision.

    Texts are compared in normalised form; norm_id is its digest. Counts have a partial
    stage, so a text that fills a third of a corpus is no burden.
    """
    n = T.normalize(F.col("text"))
    at = lambda s: F.count_if(F.col("side") == s)
    return paragraphs.filter(n != "").groupBy("pair_id", F.sha2(n, 256).alias("norm_id")).agg(at("original").alias("before"), at("revised").alias("after")).filter("before >= 2")


def changed_flags(described: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """pair_id, any_change: whether anything changed in a pair."""
    out = described.groupBy("pair_id").agg(F.bool_or(F.col("kind") != "unchanged").alias("c"))
    if tables is not None:
        out = out.unionByName(tables.groupBy("pair_id").agg(F.bool_or(F.col("kind") != "unchanged").alias("c"))).groupBy("pair_id").agg(F.bool_or("c").alias("c"))
    return out.withColumnRenamed("c", "any_change")
