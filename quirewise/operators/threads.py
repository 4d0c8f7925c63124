"""Comments: threads, context, numbering and headings that carry forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.session import cut


def thread_roots(comments: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """keys, id, root: the comment at the top of each thread.

    `comments` has the keys, id, parent_id. Every round doubles the pointers, so a thread
    ends after the logarithm of its depth. A parent that does not exist counts as none;
    what ends in a circle of replies has the smallest id of the circle as its root.
    """
    ids = comments.select(*keys, F.col("id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    x = comments.select(*keys, "id", "parent_id").join(ids, [*keys, "parent_id"], "left")
    up = F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("id"))
    x = cut(x.select(*keys, "id", up.alias("up"), F.least("id", up).alias("least")))
    most = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    reach = 1
    while reach < most:
        above = x.select(*keys, F.col("id").alias("up"), F.col("up").alias("next"), F.col("least").alias("least_above"))
        y = cut(x.join(above, [*keys, "up"]).select(*keys, "id", F.col("next").alias("up"), F.least("least", "least_above").alias("least"), (F.col("next") != F.col("up")).alias("moved")))
        reach *= 2
        x = y.drop("moved")
        if y.filter("moved").isEmpty():
            break
    end = x.select(*keys, F.col("id").alias("up"), F.col("least").alias("root"))
    return x.drop("least").join(end, [*keys, "up"]).select(*keys, "id", "root")


def anchor_context(anchors: DataFrame, paragraphs: DataFrame, reach: int = 2) -> DataFrame:
    """pair_id, id, before, after: the texts of up to `reach` paragraphs around each anchor.

    `anchors` has pair_id, id, paragraph_start, paragraph_end (may be null). The range
    join is an equi-join on the few numbers around the anchor.
    """
    end = F.coalesce("paragraph_end", "paragraph_start")
    near = F.array(*[F.struct(F.lit(s).alias("where"), n.alias("number")) for k in range(1, reach + 1) for s, n in (("before", F.col("paragraph_start") - k), ("after", end + k))])
    x = anchors.filter("paragraph_start is not null").select("pair_id", "id", F.inline(near)).join(paragraphs.select("pair_id", "number", "text"), ["pair_id", "number"])
    text = lambda w: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("where") == w, F.struct("number", "text")))), lambda t: t["text"]), "\n").alias(w)
    return x.groupBy("pair_id", "id").agg(text("before"), text("after"))


def number_issues(comments: DataFrame, span: int = 256) -> DataFrame:
    """pair_id, id, issue_id: RT-001 and so on, by place and numeric id (W6); what has no place or number comes last.

    Rows are numbered within ranges of `span` places (or ids, where there is no place) and
    shifted by the counts of the ranges before, so a large pair is no single task.
    """
    far = F.lit(10**9)
    place, number = F.coalesce("paragraph_start", far), F.coalesce(F.col("id").try_cast("int"), far)
    part = F.struct(F.floor(place / span).alias("p"), F.when(place == far, F.floor(number / span)).otherwise(0).alias("q"))
    x = comments.select("pair_id", "id", place.alias("place"), number.alias("number"), part.alias("part"))
    counts = x.groupBy("pair_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("pair_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("pair_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    k = F.row_number().over(Window.partitionBy("pair_id", "part").orderBy("place", "number", "id"))
    return x.withColumn("k", k).join(shift, ["pair_id", "part"]).select("pair_id", "id", F.format_string("RT-%03d", F.col("k") + F.col("shift")).alias("issue_id"))


def carry_headings(blocks: DataFrame) -> DataFrame:
    """The blocks of reports with the reviewer and severity in force.

    `blocks` has report_id, ord, kind, text. A heading that names a severity sets it; one
    that names a reviewer sets the reviewer and clears the severity, also its own.
    """
    minor = r"(?i)\b(minor|typographical|editorial|typos?|suggestions?|optional)\b"
    major = r"(?i)\b(major|critical|essential|serious|significant)\b"
    who = r"(?i)^(?:comments?\s+(?:from|by)\s+)?(reviewer\s*(?:#|no\.?)?\s*\w{1,3}|referee\s*(?:#)?\s*\w{1,3}|supervisor|editor|examiner|client|reader)\b"
    heading, t = F.col("kind") == "heading", F.trim("text")
    named = F.when(heading & t.rlike(who), F.initcap(F.regexp_replace(F.regexp_extract(t, who, 1), r"\s+", " ")))
    level = F.when(heading & t.rlike(who), "").when(heading & t.rlike(minor), "minor").when(heading & t.rlike(major), "major")
    so_far = Window.partitionBy("report_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumns({"reviewer": F.coalesce(F.last(named, ignorenulls=True).over(so_far), F.lit("")), "severity": F.nullif(F.last(level, ignorenulls=True).over(so_far), F.lit(""))})


def reviewer_headings(issues: DataFrame, span: int = 256) -> DataFrame:
    """The issues with `new_heading`: whether a letter names a reviewer above this one (W8, A16): where it differs from the one before, if a pair has several.

    The order is that of the requests' numbers (RT-1000 comes after RT-999), then of the
    ids as text; ids without a number come last. Rows are cut into ranges of `span`
    numbers that are compared apart, and the last reviewer of the range before is
    carried over, so a large pair is no single task.
    """
    number = F.coalesce(F.regexp_extract("id", r"(\d+)\D*$", 1).try_cast("bigint"), F.lit(1 << 62))
    x = issues.withColumn("_at", F.struct(number.alias("n"), F.col("id").alias("i"))).withColumn("_part", F.floor(F.col("_at.n") / span)).withColumn("_who", F.struct("reviewer"))
    last = x.groupBy("pair_id", "_part").agg(F.max_by("_who", "_at").alias("_last"))
    carry = last.select("pair_id", "_part", F.lag("_last").over(Window.partitionBy("pair_id").orderBy("_part")).alias("_carry"))
    several = issues.groupBy("pair_id").agg((F.count_distinct("reviewer") > 1).alias("_several"))
    near = F.lag("_who").over(Window.partitionBy("pair_id", "_part").orderBy("_at"))
    x = x.withColumn("_near", near).join(carry, ["pair_id", "_part"]).join(several, "pair_id")
    before = F.coalesce("_near", "_carry")["reviewer"]
    return x.withColumn("new_heading", F.col("_several") & ~F.col("reviewer").eqNullSafe(before)).drop("_at", "_part", "_who", "_near", "_carry", "_several")
