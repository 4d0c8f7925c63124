"""One UTC instant for timestamps written in many formats, zones and precisions."""

from __future__ import annotations

import struct
import zoneinfo
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from importlib import resources
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.session import cut

DAY = 86_400_000_000
FIRST_YEAR, LAST_YEAR = 1900, 2500
#: Days between looks at a zone's clock after the last change its file lists, where a yearly rule goes on; the rule's two spells of a year are longer.
STEP_DAYS = 5
#: Last year covered for zones of no office in a stream, where all zones are taken.
LAST_YEAR_OF_STREAMS = 2100
#: The first wall-clock instant that the table of intervals covers.
_FIRST_US = -25_567 * DAY

# Month names in English, German, French and Spanish, lower-cased; abbreviations are the first three letters.
MONTHS = {
    1: "january januar janvier enero jan jän janv ene",
    2: "february februar février fevrier febrero feb févr fév",
    3: "march märz maerz mars marzo mar mär mrz",
    4: "april avril abril apr avr abr",
    5: "may mai mayo",
    6: "june juni juin junio jun",
    7: "july juli juillet julio jul juil",
    8: "august août aout agosto aug aoû ago",
    9: "september septembre septiembre sep sept",
    10: "october oktober octobre octubre oct okt",
    11: "november novembre noviembre nov",
    12: "december dezember décembre decembre diciembre dec dez déc dic",
}

# Zone names that mean UTC everywhere.
UTC_NAMES = ("Z", "UTC", "GMT", "UT")

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5})?"
_REGION = r"(?:\[([A-Za-z0-9_+\-/]+)\])?"

#: Pattern, then what its groups mean: year|month|day|hour|minute|second|fraction|half|zone|region.
#: `a`, `b`, `c` are the three parts of a slashed date, in the order of the office.
FORMATS = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_TIME} ?{_ZONE}{_REGION})?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", r"^(\d{4})(\d{2})(\d{2})(?:[Tt](\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?(Z|z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})(?:,? {_TIME}(?: ?([AaPp][Mm]))?)?$", "$3|$2|$1|$4|$5|$6|$7|$8||"),
    ("day_first", rf"^(?:[A-Za-z]{{3,9}}, ?)?(\d{{1,2}})(?:\.? |-)([^\W\d_]{{3,}})\.?(?: |-)(\d{{4}})(?:,? (?:à |um |at )?(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)?(?: ?([AaPp][Mm]))?(?: Uhr)?(?: ?{_ZONE[:-1]})?)?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    ("month_first", rf"^([^\W\d_]{{3,}})\.? (\d{{1,2}}), (\d{{4}})(?:,? {_TIME}(?: ?([AaPp][Mm]))?)?$", "$3|$1|$2|$4|$5|$6|$7|$8||"),
)
SLASHED = rf"^(\d{{1,4}})/(\d{{1,2}})/(\d{{1,4}})(?:,? {_TIME}(?: ?([AaPp][Mm]))?)?$"
_SLASH_FIELDS = {"DMY": "$3|$2|$1", "MDY": "$3|$1|$2", "YMD": "$1|$2|$3"}


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integer arithmetic."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("bigint")


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28).otherwise(31)


def parse_stamp(df: DataFrame, text: str, date_order: str) -> DataFrame:
    """Add `_stamp`: struct(local_us, utc_us, zone, region) read from the text, or null if it is no date.

    `local_us` is the wall-clock time as microseconds since 1970-01-01T00:00 there;
    `utc_us` is set instead where the text is an instant by itself (seconds or
    milliseconds since 1970). `zone` is an offset or abbreviation in the text, `region`
    a zone name in square brackets. Only built-in expressions are used.
    """
    s = F.trim(F.regexp_replace(F.col(text), r"(?U)[\s\x1c-\x1f]+", " "))
    fields = F.lit(None).cast("string")
    for order, abc in _SLASH_FIELDS.items():
        hit = s.rlike(SLASHED) & (F.col(date_order) == order)
        if order == "YMD":
            fields = F.when(hit | s.rlike(r"^\d{4}/"), F.regexp_replace(s, SLASHED, abc + "|$4|$5|$6|$7|$8||")).otherwise(fields)
        else:
            fields = F.when(hit, F.regexp_replace(s, SLASHED, abc + "|$4|$5|$6|$7|$8||")).otherwise(fields)
    fields = F.when(s.rlike(SLASHED), fields)
    for _, pattern, order in FORMATS[::-1]:
        p = f"(?U){pattern}" if "[^\\W" in pattern else pattern
        fields = F.when(s.rlike(p), F.regexp_replace(s, p, order)).otherwise(fields)
    serial, week = r"^\d{5}(?:\.\d+)?$", r"^(\d{4})-?W(\d{2})-?([1-7])$"
    names = F.create_map(*[F.lit(x) for m, words in MONTHS.items() for w in words.split() for x in (w, str(m))])
    df = df.withColumn("_s", s).withColumn("_f", F.split(fields, r"\|"))
    at = lambda i: F.try_element_at(F.col("_f"), F.lit(i + 1))
    num = lambda i: F.expr(f"try_cast(nullif(try_element_at(_f, {i + 1}), '') as bigint)")
    year = F.when(F.length(at(0)) == 2, num(0) + 2000).when(F.length(at(0)) == 4, num(0))
    month = F.coalesce(num(1), F.try_element_at(names, F.lower(at(1))).cast("bigint"))
    df = df.withColumns({"_y": year, "_m": month, "_d": num(2), "_h": F.coalesce(num(3), F.lit(0)), "_i": F.coalesce(num(4), F.lit(0)), "_x": F.coalesce(num(5), F.lit(0)), "_p": F.lower(at(7))})
    half = F.length("_p") > 0
    hour = F.when(~half | F.col("_p").isNull(), F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_p") == "pm", 12).otherwise(0))
    ok = F.col("_m").between(1, 12) & F.col("_d").between(1, _month_length(F.col("_y"), F.col("_m"))) & F.col("_y").between(1, 9999) & hour.between(0, 23) & F.col("_i").between(0, 59) & F.col("_x").between(0, 59)
    micro = F.rpad(F.substring(F.coalesce(at(6), F.lit("")), 1, 6), 6, "0").cast("bigint")
    clock = hour.cast("bigint") * 3_600_000_000 + F.col("_i") * 60_000_000 + F.col("_x") * 1_000_000 + micro
    wall = F.when(ok, _days(F.col("_y"), F.col("_m"), F.col("_d")) * DAY + clock)

    # ISO week date: day 1 of week 1 is the Monday of the week with 4 January; week 53 must lie in its year.
    wy, ww, wd = (F.regexp_extract("_s", week, i).try_cast("bigint") for i in (1, 2, 3))
    start = lambda y: _days(y, F.lit(1), F.lit(4)) - (_days(y, F.lit(1), F.lit(4)) + 3) % 7
    monday = start(wy) + (ww - 1) * 7
    week_us = F.when((ww >= 1) & (monday < start(wy + 1)) & (wy >= 1), (monday + wd - 1) * DAY)
    # Day number: day 0 is 1899-12-30, wall-clock time, rounded to the second.
    serial_us = F.round(F.col("_s").try_cast("decimal(20,12)") * 86400).cast("bigint") * 1_000_000 - 25569 * DAY
    local = F.when(F.col("_s").rlike(serial), serial_us).when(F.col("_s").rlike(week), week_us).otherwise(wall)
    instant = F.when(F.col("_s").rlike(r"^\d{10}$"), F.col("_s").try_cast("bigint") * 1_000_000).when(F.col("_s").rlike(r"^\d{13}$"), F.col("_s").try_cast("bigint") * 1000)
    blank = lambda c: F.when(F.length(c) > 0, c)
    stamp = F.when(local.isNotNull() | instant.isNotNull(), F.struct(local.alias("local_us"), instant.alias("utc_us"), F.upper(blank(at(8))).alias("zone"), blank(at(9)).alias("region")))
    return df.withColumn("_stamp", stamp).drop("_s", "_f", "_y", "_m", "_d", "_h", "_i", "_x", "_p")


def _listed(zone: str) -> tuple[list[int], bool]:
    """The instants of the changes that a zone's file lists (RFC 9636), and whether a yearly rule goes on after them."""
    paths = [Path(folder, zone) for folder in zoneinfo.TZPATH]
    path = next((p for p in paths if p.is_file()), None)
    raw = path.read_bytes() if path else resources.files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()

    def header(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", raw[at + 20 : at + 44])

    at, wide = 0, 4
    if raw[4:5] >= b"2":
        isutc, isstd, leap, times, types, chars = header(0)
        at, wide = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isutc, 8
    isutc, isstd, leap, times, types, chars = header(at)
    begin = at + 44
    found = list(struct.unpack(f">{times}{'q' if wide == 8 else 'l'}", raw[begin : begin + times * wide]))
    foot = raw[begin + times * (wide + 1) + types * 6 + chars + leap * (wide + 4) + isstd + isutc :] if wide == 8 else b""
    return found, b"," in foot


def _intervals_of(zone: str, first: int, last: int) -> list[tuple[int, int, int, str]]:
    """(utc_from, utc_to, offset, abbreviation) in seconds, covering the years of the zone.

    The changes listed in the zone's file are taken as they are, however short a spell;
    only the rule after the last of them is scanned.
    """
    z = zoneinfo.ZoneInfo(zone)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def state(t: int) -> tuple[int, str]:
        x = (epoch + timedelta(seconds=t)).astimezone(z)
        return int(x.utcoffset().total_seconds()), x.tzname() or ""

    begin = int((datetime(first, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) - 2 * 86400
    end = int((datetime(last + 1, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) + 2 * 86400
    listed, goes_on = _listed(zone)
    out, since, now = [], begin, state(begin)
    for at in listed:
        if begin < at < end and (new := state(at)) != now:
            out.append((since, at, *now))
            since, now = at, new
    t = max([begin, *listed[-1:]])
    while goes_on and t < end:
        nxt = min(t + STEP_DAYS * 86400, end)
        new = state(nxt)
        if new != now:
            lo, hi = t, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if state(mid) == now else (lo, mid)
            out.append((since, hi, *now))
            since, t = hi, hi
            now = state(hi)
            continue
        t = nxt
    out.append((since, end, *now))
    return out


def zone_intervals(spark: SparkSession, zones: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """tz, year, intervals: the offsets in force in each local year of the zones named in column `tz`.

    An interval is struct(lo_us, hi_us, offset_us, abbreviation) in local time, half open;
    the local intervals of one zone overlap where clocks go back and leave a gap where they
    go forward. Exploded by year, so an equi-join finds the few that matter. Names that are
    no zone give nothing, so the table's size is bounded by the number of zones times the years.
    """
    known = zoneinfo.available_timezones()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for zone in pdf["tz"]:
                if zone in known:
                    for lo, hi, off, name in _intervals_of(zone, first, last):
                        rows.append((zone, lo + off, hi + off, off, name.upper()))
            yield pd.DataFrame(rows, columns=["tz", "lo", "hi", "off", "name"])

    flat = zones.select("tz").filter("tz is not null").distinct().mapInPandas(build, "tz string, lo long, hi long, off long, name string")
    year = lambda c: F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int")))
    us = 1_000_000
    return (
        flat.withColumn("year", F.explode(F.sequence(year(F.col("lo")), year(F.col("hi") - 1))))
        .groupBy("tz", "year")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("lo") * us).alias("lo_us"), (F.col("hi") * us).alias("hi_us"), (F.col("off") * us).alias("offset_us"), F.col("name").alias("abbreviation")))).alias("intervals"))
    )


def zone_abbreviations(intervals: DataFrame) -> DataFrame:
    """tz, names: what each abbreviation of a zone meant, from (local microseconds) on, as a map of arrays of struct(from_us, offset_us) in order."""
    each = intervals.select("tz", F.explode("intervals").alias("i")).filter(F.col("i.abbreviation").rlike("^[A-Z]")).groupBy("tz", F.col("i.abbreviation").alias("name"), F.col("i.lo_us").alias("from_us"), F.col("i.offset_us").alias("offset_us")).agg(F.lit(1))
    one = each.groupBy("tz", "name").agg(F.array_sort(F.collect_list(F.struct("from_us", "offset_us"))).alias("uses"))
    return one.groupBy("tz").agg(F.map_from_entries(F.collect_list(F.struct("name", "uses"))).alias("names"))


def utc_text(us: Column) -> Column:
    """Microseconds since 1970 as YYYY-MM-DDTHH:MM:SS.ffffffZ, whatever the session's zone."""
    day = F.floor(us / DAY).cast("bigint")
    rest = us - day * DAY
    pad = lambda c, n: F.lpad(c.cast("bigint").cast("string"), n, "0")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")
    return F.concat(
        date, F.lit("T"), pad(F.floor(rest / 3_600_000_000), 2), F.lit(":"), pad(F.floor(rest / 60_000_000) % 60, 2), F.lit(":"), pad(F.floor(rest / 1_000_000) % 60, 2), F.lit("."), pad(rest % 1_000_000, 6), F.lit("Z")
    )


def to_utc(df: DataFrame, offices: DataFrame, text: str = "date", office: str = "office", out: str = "utc", texts: DataFrame | None = None) -> DataFrame:
    """Add column `out`: the UTC instant of each text, or `ambiguous`, or `invalid`; null for a null or blank text.

    A zone in the text holds; otherwise the text is wall-clock time at the record's
    office, matched to the zone's offset intervals: two matches are `ambiguous`, none
    is `invalid`. An abbreviation is joined as of its time: the interval of the office's
    zone in which the wall clock read so and the abbreviation was in use gives the offset;
    where none holds the time (summer time named in winter), the latest use before it, else
    the first. `invalid` also stands where the text is no date, the date or time does not
    exist, the zone in the text is unknown at the office, or a wall-clock time has no office.
    Years before 1900 take the zone's offset at the start of 1900, years after 2500 the rule
    of the same year of the calendar 400 years before. Slashed dates of an
    office without date_order are `invalid` unless the year comes first. The input's other
    columns are kept; names starting with an underscore and `_q_` are reserved. Repeated
    rows each get their result. Zones named in brackets are gathered in a pass over the
    text column of `texts`, by default df; give the stored table where df is costly. Of a
    stream, which cannot be looked through beforehand, all known zones are taken, those of
    no office up to 2100.
    """
    spark = df.sparkSession
    small = offices.groupBy(F.col("office").alias("_q_office")).agg(F.min("tz").alias("_q_tz"), F.min("date_order").alias("_q_order"))
    # Bounds: offices is a fixed table; intervals hold zones x years. Neither grows with the records.
    x = df.join(F.broadcast(small), F.col(office) == F.col("_q_office"), "left")
    x = parse_stamp(x, text, "_q_order")
    named = F.regexp_extract(F.col(text), r"\[([A-Za-z0-9_+\-/]+)\]", 1)
    own = small.select(F.col("_q_tz").alias("tz"))
    given_texts = df if texts is None else texts
    if given_texts.isStreaming:
        others = spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "tz string").repartition(spark.sparkContext.defaultParallelism).join(own, "tz", "left_anti")
        intervals = cut(zone_intervals(spark, own).unionByName(zone_intervals(spark, others, last=LAST_YEAR_OF_STREAMS)))
    else:
        regions = given_texts.filter(F.col(text).contains("[")).select(named.alias("tz")).distinct()
        intervals = cut(zone_intervals(spark, own.unionByName(regions)))
    zone = F.col("_stamp.zone")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("bigint"), F.coalesce(F.substring(digits, 3, 2).try_cast("bigint"), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes <= 59), (hours * 3600 + minutes * 60) * 1_000_000 * F.when(zone.startswith("-"), -1).otherwise(1))
    local = F.col("_stamp.local_us")
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local / DAY).cast("int")))
    # The calendar repeats after 400 years; the table covers FIRST_YEAR to LAST_YEAR.
    turns = F.when(year > LAST_YEAR, F.ceil((year - LAST_YEAR) / 400)).otherwise(0)
    x = x.withColumn("_q_shift", F.coalesce(turns.cast("bigint"), F.lit(0)) * (146_097 * DAY)).withColumn("_q_local", F.greatest(local - F.col("_q_shift"), F.lit(_FIRST_US)))
    x = x.withColumn("_q_zone", F.when(F.col("_stamp.utc_us").isNull(), F.when(zone.isNull(), F.coalesce(F.col("_stamp.region"), F.col("_q_tz"))).when(~zone.isin(*UTC_NAMES) & ~zone.rlike(r"^[+-]\d"), F.col("_q_tz"))))
    x = x.withColumn("_q_year", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("_q_local") / DAY).cast("int"))))
    x = x.join(F.broadcast(intervals.select(F.col("tz").alias("_q_itz"), F.col("year").alias("_q_iyear"), F.col("intervals").alias("_q_in"))), (F.col("_q_zone") == F.col("_q_itz")) & (F.col("_q_year") == F.col("_q_iyear")), "left")
    x = x.join(F.broadcast(zone_abbreviations(intervals).select(F.col("tz").alias("_q_atz"), F.col("names").alias("_q_names"))), (F.col("_q_tz") == F.col("_q_atz")) & zone.isNotNull(), "left")
    hits = F.filter("_q_in", lambda i: (i["lo_us"] <= F.col("_q_local")) & (F.col("_q_local") < i["hi_us"]))
    offsets = lambda a: F.coalesce(F.transform(a, lambda i: i["offset_us"]), F.expr("cast(array() as array<bigint>)"))
    x = x.withColumn("_q_hits", offsets(hits))
    here = offsets(F.filter(hits, lambda i: i["abbreviation"] == F.col("_stamp.zone")))
    uses = F.try_element_at(F.col("_q_names"), zone)
    before = offsets(F.filter(uses, lambda u: u["from_us"] <= F.col("_q_local")))
    meant = F.coalesce(F.try_element_at(here, F.lit(1)), F.try_element_at(before, F.lit(-1)), F.try_element_at(offsets(uses), F.lit(1)))
    given = F.when(zone.isin(*UTC_NAMES), F.lit(0).cast("bigint")).when(zone.rlike(r"^[+-]\d"), numeric).otherwise(meant)
    x = x.withColumn("_q_given", given)
    result = (
        F.when(F.trim(F.regexp_replace(F.col(text), r"(?U)[\s\x1c-\x1f]+", " ")) == "", None)
        .when(F.col(text).isNull(), None)
        .when(F.col("_stamp").isNull(), "invalid")
        .when(F.col("_stamp.utc_us").isNotNull(), utc_text(F.col("_stamp.utc_us")))
        .when(zone.isNotNull() & F.col("_q_given").isNull(), "invalid")
        .when(zone.isNotNull(), utc_text(local - F.col("_q_given")))
        .when(F.size("_q_hits") > 1, "ambiguous")
        .when(F.size("_q_hits") == 0, "invalid")
        .otherwise(utc_text(local - F.try_element_at(F.col("_q_hits"), F.lit(1))))
    )
    return x.withColumn(out, result).drop("_stamp", "_q_office", "_q_tz", "_q_order", "_q_given", "_q_zone", "_q_year", "_q_itz", "_q_iyear", "_q_in", "_q_hits", "_q_shift", "_q_local", "_q_atz", "_q_names")
