"""Variant spellings of the names of people and organisations."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.blocks import block_pairs
from quirewise.llm.components import connected_components
from quirewise.session import cut

# Nicknames with the given name they stand for.
NICKNAMES = {
    "abby": "abigail", "abbie": "abigail", "gail": "abigail", "alex": "alexander", "sandy": "alexander", "al": "albert", "andy": "andrew", "drew": "andrew",
    "tony": "anthony", "art": "arthur", "barb": "barbara", "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth",
    "lizzie": "elizabeth", "liz": "elizabeth", "lisa": "elizabeth", "cathy": "catherine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine",
    "chuck": "charles", "charlie": "charles", "chas": "charles", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david",
    "debbie": "deborah", "deb": "deborah", "debby": "deborah", "don": "donald", "doug": "douglas", "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward",
    "fran": "frances", "frank": "francis", "fred": "frederick", "freddie": "frederick", "gene": "eugene", "greg": "gregory", "hank": "henry", "harry": "henry",
    "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "jeff": "jeffrey", "jerry": "gerald", "joe": "joseph", "joey": "joseph",
    "jack": "john", "johnny": "john", "jon": "jonathan", "josh": "joshua", "judy": "judith", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "lenny": "leonard",
    "leo": "leonard", "lucy": "lucinda", "cindy": "lucinda", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "marge": "margaret", "greta": "margaret",
    "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "nan": "nancy", "nat": "nathaniel", "nate": "nathaniel", "nick": "nicholas",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "phil": "philip", "pip": "philippa", "pippa": "philippa",
    "ray": "raymond", "becky": "rebecca", "becca": "rebecca", "dick": "richard", "rick": "richard", "rich": "richard", "richie": "richard", "bob": "robert",
    "bobby": "robert", "rob": "robert", "robbie": "robert", "ron": "ronald", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "stephen": "stephen", "steven": "stephen",
    "sue": "susannah", "susie": "susannah", "suzy": "susannah", "susan": "susannah", "terry": "theresa", "tess": "theresa", "tom": "thomas", "tommy": "thomas",
    "tim": "timothy", "timmy": "timothy", "toni": "antonia", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "val": "valerie", "bill": "william",
    "billy": "william", "will": "william", "willy": "william", "liam": "william", "ronnie": "veronica", "vera": "veronica", "zach": "zachary", "zack": "zachary",
}
# Words for kinds of organisation, with their abbreviations.
ORG_WORDS = {
    "university": "univ uni", "institute": "inst", "department": "dept dep", "centre": "ctr center cent cntr", "association": "assoc assn", "foundation": "fdn found fndn",
    "committee": "cttee comm cte", "laboratory": "lab labs", "council": "cncl", "society": "soc", "agency": "agcy", "academy": "acad", "college": "coll", "school": "sch",
    "faculty": "fac", "office": "off", "ministry": "min", "board": "bd", "group": "grp", "hospital": "hosp", "company": "co", "corporation": "corp", "bureau": "bur", "commission": "commn",
}
# Words that carry no identity.
SMALL_WORDS = frozenset("of for f the and and& in at on de".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd".split())
ROLE = re.compile(r"^(?:(?:handling|associate|academic|section|chief|managing|guest)? ?(?:editor)|reviewer|referee|examiner|author|authors|client|customer|anonymous|anon|supervisor|advisor|admin|user|unknown|guest|r|rev|ref)[ #.\-_no]*\d*$")
# Letters that do not decompose to a base letter.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ı": "i"})
# Classes of consonants that sound alike.
SOUNDS = {c: str(i) for i, group in enumerate(("bp", "fvw", "ckqgx", "jy", "dt", "l", "mn", "r", "sz", "h")) for c in group if c not in "y"}

_SPELT = {abbr: word for word, abbrs in ORG_WORDS.items() for abbr in (word, *abbrs.split())}
_AMBIGUOUS = frozenset("min off co sch school group bd comm found fac uni".split())


#: Forms of one block that meet in one task; larger blocks are split into pairs of parts.
BLOCK = 1024


def fold(text: str) -> str:
    """Lower case, without accents."""
    t = unicodedata.normalize("NFKD", text.casefold()).translate(LETTERS)
    return "".join(c for c in t if not unicodedata.combining(c))


def sound(word: str) -> str:
    """Consonant classes in order; vowels, y and marks are dropped."""
    return "".join(SOUNDS.get(c, "") for c in word)


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity, prefix weight 0.1 over at most four letters."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken = [False] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j in range(m) if taken[j]]
    k = len(left)
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    prefix = 0
    while prefix < min(4, n, m) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _org(tokens: list[tuple[str, bool]]) -> str | None:
    """Form of an organisation, or None. tokens: folded word, whether a full stop followed."""
    words = [(w, dot) for w, dot in tokens if w not in SMALL_WORDS]
    kinds = [i for i, (w, _) in enumerate(words) if w in _SPELT and w not in _AMBIGUOUS]
    if not kinds:
        kinds = [i for i, (w, _) in enumerate(words) if w in _SPELT]
    if not kinds and len(words) >= 3:
        kinds = [i for i, (w, _) in enumerate(words) if len(w) >= 6 and any(one_edit(w, x) for x in ORG_WORDS)]
    if not kinds or len(words) < 3:
        return None
    w = words[kinds[0]][0]
    kind = _SPELT.get(w) or next(x for x in ORG_WORDS if one_edit(w, x))
    rest = sorted(x + "." * dot for i, (x, dot) in enumerate(words) if i != kinds[0])
    return f"o|{kind}|{' '.join(rest)}"


def parse_name(name: str) -> str | None:
    """The form of a name, or None for a role label or a text without letters.

    `o|kind|words`: organisation, words sorted. `p|surname|given|initials`: a person
    whose surname is known; given may be empty, initials include the given name's.
    `u|a b|initials`: a person of two or more full words whose order is not known.
    """
    text = unicodedata.normalize("NFKC", name)
    text = re.sub("[\u200b-\u200f\u2060\ufeff\u00ad]", "", text)
    inside = re.search(r"\(([^)]*)\)", text)
    folded = fold(re.sub(r"\s+", " ", text)).strip()
    if not re.search(r"[^\W\d_]", folded) or ROLE.match(folded):
        return None
    raw = re.findall(r"([^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*)(\.?)", text)
    org = _org([(fold(w), bool(d)) for w, d in raw])
    if org:
        return org
    if inside:
        text = (text[: inside.start()] + " " + text[inside.end() :]).strip()
    head, comma, tail = text.partition(",")
    if comma and not tail.strip():
        head, comma = text.replace(",", " "), ""

    def words(part: str) -> tuple[list[str], list[str]]:
        """Full words and initials of a part, in order."""
        full, initials = [], []
        tokens = [t for t in re.split(r"[\s_,;/]+", part) if t]
        for t in tokens:
            bare = re.sub(r"[^\w'’\-]", "", t)
            letters = re.sub(r"[\W\d_]", "", t)
            # D.R. and, behind another word, DR are initials; Dr, Dr. and a leading DR are a title.
            dotted = re.fullmatch(r"(?:[^\W\d_]\.){2,}", t) or (letters.isupper() and len(letters) == 2 and t is not tokens[0] and not part.isupper())
            if not letters or (fold(letters) in TITLES and not dotted):
                continue
            if len(letters) == 1 or re.fullmatch(r"(?:[^\W\d_]\.[\s\-]?)+[^\W\d_]?\.?", t):
                initials += list(fold(letters))
            elif len(letters) <= 3 and letters.isupper() and len(tokens) > 1 and not part.isupper():
                initials += list(fold(letters))
            elif len(letters) == 2 and letters.isupper() and len(tokens) > 1:
                initials += list(fold(letters))
            else:
                camel = re.fullmatch(r"([A-ZÀ-ÖØ-Þ][^\WA-ZÀ-ÖØ-Þ\d_]+)([A-ZÀ-ÖØ-ÞČŁŠŽ][^\W\d_]+)", letters) if len(tokens) == 1 else None
                full += [fold(camel[1]), fold(camel[2])] if camel and not re.match(r"^(Mc|Mac|De|Van|Von|La|Le|Di|Du)[A-Z]", letters) else [fold(re.sub(r"['’\-]", "", bare))]
        return full, initials

    if comma:
        last, _ = words(head)
        given, initials = words(tail)
        if not last:
            return None
        surname = " ".join(last)
        first = given[0] if given else ""
        return f"p|{surname}|{first}|{(first[:1] if first else '') + ''.join(initials)}"
    full, initials = words(text)
    if not full:
        return None
    if len(full) == 1:
        if initials:
            return f"p|{full[0]}||{''.join(initials)}"
        word = full[0]
        return f"p|{word[1:]}||{word[0]}" if len(word) > 4 and text.strip() == text.strip().lower() else f"p|{word}||"
    if len(full) > 2:
        full = [full[0], " ".join(full[1:])]
    return f"u|{'|'.join(full)}|{''.join(initials)}"


def readings(form: str) -> list[tuple[str, str, str, str]]:
    """(surname, given, initial of the given name, further initials) for each reading of a person's form."""
    parts = form.split("|")
    if parts[0] == "p":
        return [(parts[1], parts[2], parts[3][:1], parts[3][1:])]
    a, b, rest = parts[1], parts[2], parts[3]
    return [(b, a, a[:1], rest), (a, b, b[:1], rest)]


def canonical_given(word: str) -> str:
    return NICKNAMES.get(word, word)


def is_weak(form: str) -> bool:
    """Whether only initials stand for the given name."""
    return form[0] == "p" and not form.split("|")[2]


def _left_out(word: str) -> set[str]:
    """A word and what is left with one letter out, of long ones both ends: words within one edit share one."""
    ends = {f"^{word[:24]}", f"${word[-24:]}"} if len(word) > 60 else set()
    return ends | ({word} | {word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) <= 70 else set())


def _near_codes(code: str) -> set[str]:
    """Codes of which a code within one edit shares one: with one sound left out; of long ones, both ends."""
    return _left_out(code)


def _stable(text: str) -> int:
    """A 64-bit hash that is the same in every worker."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _org_keys(kind: str, words: list[str]) -> set[str]:
    """Keys of an organisation: forms that compare() accepts share one.

    Same and abbreviated words begin with the same two letters, and at most one word
    holds a slip. So either the beginnings of all words agree, or those of all but one,
    which then shares a code of its sounds (of its letters where it has hardly any sound).
    Beginnings enter as a sum of hashes, whose collisions only add candidates.
    """
    starts = [_stable(w.rstrip(".")[:2]) for w in words]
    total, size = sum(starts), len(words)
    keys = {f"o{kind}:{size}:{total % (1 << 64):x}"}
    for w, start in set(zip(words, starts)):
        bare = w.rstrip(".")
        if len(bare) >= FEWEST_LETTERS - 1:
            code = sound(bare)
            near = {f"s{c}" for c in _near_codes(code) if c} | ({f"l{c}" for c in _near_codes(bare)} if len(code) <= 2 else set())
            keys |= {f"o{kind}:{size}:{(total - start) % (1 << 64):x}:{c}" for c in near}
    return keys


def block_keys(form: str) -> list[str]:
    """Blocking keys: of persons, phonetic codes and codes with one sound left out, with the initial; of organisations, see _org_keys.

    Forms that compare() accepts share a key, because an edit changes at most one sound or
    swaps two. Surnames of few sounds also give their letters with one left out, and equal
    surnames the given name's, whose slip may be in its initial.
    """
    if form[0] == "o":
        _, kind, rest = form.split("|")
        return sorted(_org_keys(kind, rest.split()))
    keys = set()
    for surname, given, initial, _ in readings(form):
        code = sound(surname)
        # Fewer than three sounds are shared by too many names; there the letters themselves are taken.
        codes = {f"s{c}" for c in _near_codes(code)} if len(code) >= 4 else {f"l{c}" for c in _left_out(surname)} | ({f"s{c}" for c in _near_codes(code) if len(c) >= 3})
        starts = {initial, canonical_given(given)[:1]} - {""} or {"?"}
        keys |= {f"p{s}:{c}" for c in codes for s in starts}
        if given:
            # The given name's slip may be in its first letter; the surname is the same then.
            keys |= {f"g{surname}:{x}" for x in _left_out(given)}
    return sorted(keys)


#: Least Jaro-Winkler similarity of two spellings of one word, fitted on clusters of spellings (see README), and fewest letters of such a word.
#: In words of three letters the score pairs letters of the same place only, so a swap scores low.
LEAST_JARO_WINKLER, LEAST_OF_THREE, FEWEST_LETTERS = 0.77, 0.55, 3


def _slip(a: str, b: str) -> int | None:
    """0 for the same word, 1 for a typing slip, None for different words.

    Jaro-Winkler decides which words may be one; the exact check after it asks that one
    slip of the keyboard explains the difference, since different surnames reach scores
    of 0.96 and more.
    """
    if a == b:
        return 0
    # One edit in a hundred letters or more is above any threshold, so only short words are scored.
    least = LEAST_OF_THREE if len(a) == len(b) == 3 else LEAST_JARO_WINKLER
    if min(len(a), len(b)) >= FEWEST_LETTERS and abs(len(a) - len(b)) <= 1 and (len(a) > 100 or jaro_winkler(a, b) >= least) and one_edit(a, b):
        return 1
    return None


def compare(form_a: str, form_b: str) -> int | None:
    """Cost of taking two forms for one entity: 0 none, 1 one typing slip; None if they differ."""
    if (form_a[0] == "o") != (form_b[0] == "o"):
        return None
    if form_a[0] == "o":
        _, kind_a, rest_a = form_a.split("|")
        _, kind_b, rest_b = form_b.split("|")
        left, right = rest_a.split(), rest_b.split()
        if kind_a != kind_b or len(left) != len(right):
            return None
        cost = 0
        for rule in ("same", "short", "slip"):
            for w in list(left):
                for x in right:
                    short = w.endswith(".") != x.endswith(".") and min(len(w), len(x)) > 2 and (w.startswith(x[:-1]) if x.endswith(".") else x.startswith(w[:-1]))
                    slip = rule == "slip" and _slip(w.rstrip("."), x.rstrip("."))
                    if (rule == "same" and w == x) or (rule == "short" and short) or slip:
                        cost += rule == "slip"
                        left.remove(w)
                        right.remove(x)
                        break
        return cost if not left and cost <= 1 else None
    best = None
    for sa, ga, ia, ra in readings(form_a):
        for sb, gb, ib, rb in readings(form_b):
            cost = _slip(sa, sb)
            if cost is None:
                continue
            if ga and gb:
                ca, cb = canonical_given(ga), canonical_given(gb)
                more = 0 if ca == cb else _slip(ga, gb)
                if more is None:
                    continue
                cost += more
            elif ia and ib:
                if not ({ia, canonical_given(ga)[:1]} & {ib, canonical_given(gb)[:1]} - {""}):
                    continue
            if ra and rb and not (ra.startswith(rb) or rb.startswith(ra)):
                continue
            if cost <= 1 and (best is None or cost < best):
                best = cost
    return best


def name_entities(names: DataFrame, name: str = "name") -> DataFrame:
    """name, entity: which stored spellings name the same person or organisation.

    Distinct spellings are parsed to forms, forms sharing a phonetic block are compared
    (Jaro-Winkler and one slip for each word, nickname table, initials, at most one slip in all), and
    accepted pairs are clustered by connected components. Spellings with a bare
    initial would chain different people, so they join afterwards, and only where
    exactly one cluster fits them best; where none fits they cluster among themselves.
    Null and blank names, texts without letters and role labels give no row. Repeated
    names count once. Other columns are ignored. An empty table gives none.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            forms = [parse_name(x) for x in pdf["name"]]
            yield pd.DataFrame({"name": pdf["name"], "form": forms}).dropna()

    distinct = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
    parsed = cut(distinct.mapInPandas(parse, "name string, form string"))
    forms = parsed.select("form").distinct()

    @F.pandas_udf("array<string>")
    def keys(f: pd.Series) -> pd.Series:
        return f.map(block_keys)

    @F.pandas_udf("int")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([compare(x, y) for x, y in zip(a, b)], dtype="Int32")

    keyed = forms.select("form", F.explode(keys("form")).alias("key"))
    pairs = block_pairs(cut(keyed), "key", "form", BLOCK)
    weak = lambda c: F.col(c).startswith("p|") & F.col(c).contains("||")
    links = cut(pairs.withColumn("cost", cost("a", "b")).filter("cost is not null").withColumns({"wa": weak("a"), "wb": weak("b")}))
    strong = connected_components(links.filter("not wa and not wb"))
    mixed = links.filter("wa <> wb").select(F.when(F.col("wa"), F.col("a")).otherwise(F.col("b")).alias("weak"), F.when(F.col("wa"), F.col("b")).otherwise(F.col("a")).alias("node"), "cost")
    fits = mixed.join(strong, "node", "left").groupBy("weak", F.coalesce("component", "node").alias("to")).agg(F.min("cost").alias("cost"))
    by_cost = fits.groupBy("weak", "cost").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to"))
    best = by_cost.groupBy("weak").agg(F.min(F.struct("cost", "n", "to")).alias("x")).select("weak", F.col("x.n").alias("n"), F.col("x.to").alias("to"))
    fitted = best.select(F.col("weak").alias("f"), F.lit(1).alias("has"))
    loose = (
        links.filter("wa and wb")
        .join(fitted.withColumnRenamed("f", "a").withColumnRenamed("has", "ha"), "a", "left")
        .join(fitted.withColumnRenamed("f", "b").withColumnRenamed("has", "hb"), "b", "left")
        .filter("ha is null or hb is null")
        .select("a", "b")
    )
    edges = strong.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(best.filter("n = 1").select(F.col("weak").alias("a"), F.col("to").alias("b"))).unionByName(loose)
    whole = connected_components(edges).select(F.col("node").alias("form"), F.col("component").alias("entity"))
    return parsed.join(whole, "form", "left").select("name", F.coalesce("entity", "form").alias("entity"))


def name_pairs(entities: DataFrame) -> DataFrame:
    """name_a, name_b: all pairs of different spellings of one entity, name_a < name_b by code point."""
    a = entities.select("entity", F.col("name").alias("name_a"))
    b = entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
