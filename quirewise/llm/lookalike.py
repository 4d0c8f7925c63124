"""One consistent form for texts that look the same, and searches through it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm.shingles import winnowed
from quirewise.session import cut

# Letters of other scripts that look like a Latin letter.
CONFUSABLE = dict(
    zip(
        "аеорсухіјѕһԁԛԝӏѵүАВЕКМНОРСТХЅІЈУҮԌѴԚԜ" "οϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ",
        "aeopcyxijshdqwlvyABEKMHOPCTXSIJYYGVQW" "ocjABEZHIKMNOPTYXCJ",
        strict=True,
    )
)
# Hyphens that look like the ordinary one.
CONFUSABLE |= {"‐": "-", "‑": "-"}
#: Compatibility classes whose characters look like what they stand for.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")
# Further compatibility characters that look like what they stand for: micro sign, Latin ligatures and digraphs.
_ALSO = "µĳĲǄǅǆǇǈǉǊǋǌǱǲǳﬀﬁﬂﬃﬄﬅﬆ"


# Further characters that show nothing (fillers and marks that are ignored by default), as ranges.
_HIDDEN = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
# Fixed value: a blank that is no white space.
_BRAILLE_BLANK = "\u2800"


def _invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or (unicodedata.category(c) == "Cc" and not c.isspace()) or any(a <= ord(c) <= b for a, b in _HIDDEN)


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that may compose with the one before (the Maybe of the NFC quick check): second parts of canonical decompositions, and Hangul vowels and finals."""
    second = set()
    for p in range(0x30000):
        d = unicodedata.decomposition(chr(p)).split()
        if len(d) == 2 and d[0][0] != "<":
            second.add(chr(int(d[1], 16)))
    return frozenset(second) | {chr(p) for p in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


class Looks:
    """The consistent form of texts, for one table of look-alike letters."""

    def __init__(self, table: dict[str, str], pattern: str = ""):
        self.table = table
        self.pattern = re.compile(pattern, re.S) if pattern else None
        self.segment = lru_cache(maxsize=100_000)(self._segment)
        self.short = lru_cache(maxsize=200_000)(self.spliced)

    def _ordinary(self, c: str) -> str:
        """What a single character looks like, apart from composition."""
        if c.isspace() or c == _BRAILLE_BLANK:
            return " "
        if _invisible(c):
            return ""
        if c in self.table:
            return self.table[c]
        if unicodedata.decomposition(c).startswith(_SAME_LOOK) or c in _ALSO:
            return "".join(self.table.get(x, x) for x in unicodedata.normalize("NFKC", c))
        return c

    def _plain(self, t: str) -> str:
        """Decomposed, its letters replaced, and composed again."""
        return unicodedata.normalize("NFC", "".join(self.table.get(x, x) for x in unicodedata.normalize("NFD", t)))

    def _segment(self, s: str) -> str:
        """Canonical form of a segment with its boundary context."""
        return self._plain("".join(map(self._ordinary, s)))

    def unstable(self) -> re.Pattern:
        """Runs of characters that fail the quick check, with the character before them.

        A character fails where it stands for another one, does not remain itself under
        NFC, or may combine with the one before (quick check Maybe, or a combining mark).
        Everything else is the same before and after, wherever it stands.
        """
        if self.pattern is None:
            marks, joining = [], _joining()
            for low, high in ((0, 0xD800), (0xE000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
                run = None
                for p in range(low, high):
                    c = chr(p)
                    bad = p not in range(32, 127) and (unicodedata.combining(c) or c in joining or c.isspace() or self._ordinary(c) != c or self._plain(c) != c)
                    if bad and run is None:
                        run = p
                    elif not bad and run is not None:
                        marks.append((run, p - 1))
                        run = None
                if run is not None:
                    marks.append((run, high - 1))
            inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in marks)
            self.pattern = re.compile(f"[^{inside}]?[{inside}]+", re.S)
        return self.pattern

    def spliced(self, s: str) -> str:
        return self.unstable().sub(lambda m: self.segment(m.group()), s)

    def look(self, text: str) -> str:
        """The consistent form: unstable segments are normalised and spliced into what is stable.

        Printable ASCII is stable and composes with nothing before it, so runs of other
        characters, each with the character before it, are looked at apart.
        """
        out, at = [], 0
        for m in _ODD.finditer(text):
            begin = max(at, m.start() - 1)
            run = text[begin : m.end()]
            out += (text[at:begin], self.short(run) if len(run) <= 32 else self.spliced(run))
            at = m.end()
        return "".join(out) + text[at:] if out else text


_ODD = re.compile(r"[^\x20-\x7e]+")


@lru_cache(maxsize=4)
def looks(pairs: str = "", pattern: str = "") -> Looks:
    """The forms under the fixed table and, where given, further pairs of letters, one behind the other; the pattern of what is unstable, if known."""
    return Looks(dict(zip(pairs[::2], pairs[1::2])) | CONFUSABLE, pattern)


def look(text: str, pairs: str = "") -> str:
    """The consistent form of one text."""
    return looks(pairs).look(text)


def confusable_pairs(spark: SparkSession) -> str:
    """Letters that Unicode's data on confusable characters call look-alikes of a Latin letter of the same case, each with that letter.

    Read from the ICU library that Spark carries, in one call: two letters look alike
    where their skeletons are equal. Only letters count, as punctuation stays a visible
    difference. Empty where there is no such library.
    """
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        letters = [chr(p) for p in range(0x80, 0x20000) if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) in ("Lu", "Ll", "Lo", "Nl")]
        plain = [chr(p) for p in (*range(65, 91), *range(97, 123))]
        skeletons = dict(zip([*plain, *letters], checker.getSkeleton("\n".join([*plain, *letters])).split("\n")))
    except (AttributeError, TypeError):
        return ""
    upper = {skeletons[c]: c for c in plain if c.isupper()}
    lower = {skeletons[c]: c for c in plain if c.islower()}
    out = []
    for c in letters:
        # Letters of stylistic alphabets and other widths are compatibility characters, handled as such.
        own = lower if c.islower() or unicodedata.category(c) == "Lo" else upper
        if skeletons[c] in own and unicodedata.decomposition(c)[:8] in ("", "<compat>"):
            out.append(c + own[skeletons[c]])
    return "".join(out)


def canonical(text: Column) -> Column:
    """Column with the consistent form of a text.

    Printable ASCII passes a quick check in the JVM and stays as it is; only other
    texts are normalised, and of these only the unstable segments. Null stays null.
    """
    pairs = confusable_pairs(SparkSession.active())
    pattern = looks(pairs).unstable().pattern  # built once, on the driver

    @F.pandas_udf("string")
    def normalise(s: pd.Series) -> pd.Series:
        form = looks(pairs, pattern).look
        return s.map(lambda t: None if t is None else form(t))

    stable = text.rlike(r"^[\x20-\x7e]*$")
    return F.when(stable, text).otherwise(normalise(F.when(~stable, text)))


#: Tiers of stretches by length: shortest stretch served, characters in a gram, grams in a window.
TIERS = ((48, 24, 25), (16, 8, 9), (4, 3, 2), (2, 2, 1), (1, 1, 1))


def _prints(df: DataFrame) -> DataFrame:
    """id, grp, odd, tier, fps of each (id, grp, odd, form, tiers): the fingerprints in the wanted tiers, one row a text and tier."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tier, (_, k, w) in enumerate(TIERS):
                own = pdf[pdf["tiers"].map(lambda t: tier in t)]
                if len(own):
                    which, fp = winnowed(own["form"].tolist(), k, w)
                    fps = np.split(fp.view("int64"), np.searchsorted(which, np.arange(1, len(own))))
                    yield own[["id", "grp", "odd"]].assign(tier=tier, fps=fps)

    return df.select("id", "grp", "odd", "form", "tiers").mapInPandas(run, "id long, grp string, odd boolean, tier int, fps array<long>")


def find_stretches(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle_id, text_id: the texts that contain the needle, within one group, where the forms contain it but the stored strings do not.

    `needles` and `texts` have id (bigint, unique), grp (string), raw, form. Needles
    with an empty form, and null values, find nothing. Every needle is looked up by
    one fingerprint, the one that stands in the fewest texts of its group; a stretch
    in a text has all fingerprints of the needle, so none is missed, and the texts
    met are checked exactly. A needle with a fingerprint that no text has drops out
    early. Where neither side differs from its form, the stored strings contain
    whatever the forms do, so such pairs are not looked at. No pairs within a group
    are formed but those that share a rare fingerprint.
    """
    length = F.length("form")
    tier = F.coalesce(*[F.when(length >= least, k) for k, (least, _, _) in enumerate(TIERS)])
    odd = F.col("raw") != F.col("form")
    n = needles.filter("form is not null and grp is not null").filter(length > 0).select("id", "grp", F.when(odd, F.col("raw")).alias("raw"), "form", odd.alias("odd"), F.array(tier).alias("tiers"))
    wanted = n.groupBy("grp").agg(F.array_sort(F.collect_set(F.element_at("tiers", 1))).alias("tiers"))
    t = texts.filter("form is not null and grp is not null").select("id", "grp", F.when(odd, F.col("raw")).alias("raw"), "form", odd.alias("odd"))
    each = lambda df: df.select("id", "grp", "odd", "tier", F.explode("fps").alias("fp"))
    text_prints = each(cut(_prints(t.join(wanted, "grp"))))
    counts = text_prints.groupBy("grp", "tier", "fp").agg(F.count(F.lit(1)).alias("n"))
    needle_prints = each(_prints(n))
    rated = needle_prints.join(counts, ["grp", "tier", "fp"], "left").groupBy("id", "grp", "odd", "tier").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "fp")).alias("x"))
    chosen = rated.filter("x.n > 0").select(F.col("id").alias("needle_id"), "grp", F.col("odd").alias("needle_odd"), "tier", F.col("x.fp").alias("fp"))
    met = text_prints.withColumnRenamed("id", "text_id").join(chosen, ["grp", "tier", "fp"]).filter("odd or needle_odd").select("needle_id", "text_id")
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.coalesce("raw", "form").alias(f"{p}_raw"), F.col("form").alias(f"{p}_form"))
    found = met.join(side(t, "text"), "text_id").join(side(n, "needle"), "needle_id")
    return found.filter(F.col("text_form").contains(F.col("needle_form")) & ~F.col("text_raw").contains(F.col("needle_raw"))).select("needle_id", "text_id")


def same_look(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id: texts of one group that look alike without being the same string.

    Inputs have id, grp, raw, form. The join is on group and a digest of the form (128
    bits), so no text moves; null forms meet nothing. At least one of two such texts
    differs from its form, so only pairs with such a text meet. Repeated texts give every
    combination.
    """
    digest = lambda c: F.unhex(F.md5(c))
    odd = F.when(F.col("raw") != F.col("form"), digest(F.col("raw")))
    side = lambda df, p: df.filter("form is not null").select(F.col("id").alias(f"{p}_id"), "grp", digest(F.col("form")).alias("form"), odd.alias(f"{p}_odd"))
    a, b = side(left, "left"), side(right, "right")
    some = a.filter("left_odd is not null").join(b, ["grp", "form"]).filter(~F.col("left_odd").eqNullSafe(F.col("right_odd")))
    rest = a.filter("left_odd is null").join(b.filter("right_odd is not null"), ["grp", "form"])
    return some.select("left_id", "right_id").unionByName(rest.select("left_id", "right_id"))
