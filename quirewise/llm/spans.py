"""Long spans that stand verbatim in more than one document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewise.llm.shingles import grams, mix, sliding_min

#: Words in a gram of the sketch. A window of `least` words is sketched by the least hash of its grams.
GRAM = 12
#: Words handled at once in a Python worker; a longer document is taken in overlapping pieces.
CHUNK = 400_000
#: One document in so many is read to find sketches so frequent that their windows are routed apart.
HINT_SAMPLE = 32
#: Estimated rows of one sketch from which its windows are routed apart, and most sketches so treated (8 bytes each; one left out holds less than one in so many of all rows). Routing only: results are the same without.
HOT_ROWS, HOT_MOST = 20_000, 65_536


class _Hashes(dict):
    """Hash of each word, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _pieces(docs: np.ndarray, texts: list[str], least: int, memo: _Hashes, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, start, window hash, sketch) of all windows of `least` words, a bounded number at once."""
    pile: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        items = np.concatenate([p[2] for p in pile])
        lengths = [len(p[2]) for p in pile]
        owner = np.repeat(np.arange(len(pile)), lengths)
        base = np.repeat([p[1] for p in pile], lengths) + np.arange(len(items)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        window = grams(items, least)
        k = min(GRAM, least)
        sketch = sliding_min(grams(items, k), least - k + 1)
        whole = np.flatnonzero(owner[: len(window)] == owner[least - 1 :])
        ident = np.array([p[0] for p in pile], dtype=np.int64)
        return ident[owner[whole]], base[whole], window[whole], sketch[whole]

    for doc, text in zip(docs, texts):
        w = text.split()
        if len(w) < least:
            continue
        h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
        for at in range(0, len(h) - least + 1, chunk):
            part = h[at : at + chunk + least - 1]
            pile.append((int(doc), at, part))
            size += len(part)
            if size >= chunk:
                yield flush()
                pile, size = [], 0
    if pile:
        yield flush()


def _runs(doc: np.ndarray, start: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Indices at which a run of neighbouring windows of one document with equal `same` begins."""
    if not len(doc):
        return np.zeros(0, np.int64)
    new = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    for s in same:
        new |= s[1:] != s[:-1]
    return np.flatnonzero(np.r_[True, new])


def _scan(least: int, hot: np.ndarray, chunk: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (key, doc, start, w, n) of all windows.

    Ordinary rows: key is the sketch, w the hashes of neighbouring windows that have it,
    start the first one's place. Windows of a hot sketch are settled in the batch where
    two documents of the batch hold them: n > 0 gives a run known to be shared, and two
    rows with start -1 stand for them all, one for the smallest and one for the largest
    document, so that whatever else holds the window meets another document. The others
    travel alone, keyed by their own hash, with the sketch in w. So windows always meet
    on both hashes, and a hot key gets two rows a batch at most, not one for each document.
    """

    def frame(key, doc, start, w, n) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame({"key": np.asarray(key, dtype=np.uint64).view(np.int64), "doc": doc, "start": start.astype(np.int32), "w": w, "n": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Hashes()
        for pdf in batches:
            for doc, start, window, sketch in _pieces(pdf["doc"].to_numpy(), pdf["text"].tolist(), least, memo, chunk):
                apart = np.isin(sketch, hot) if len(hot) else np.zeros(len(sketch), bool)
                d, s, x, k = (v[~apart] for v in (doc, start, window, sketch))
                at = _runs(d, s, k)
                if len(at):
                    parts = np.split(x.view(np.int64), at[1:])
                    yield frame(k[at], d[at], s[at], parts, np.zeros(len(at), np.int32))
                if not apart.any():
                    continue
                d, s, x, k = (v[apart] for v in (doc, start, window, sketch))
                values, first, which = np.unique(x, return_index=True, return_inverse=True)
                low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
                np.minimum.at(low, which, d)
                np.maximum.at(high, which, d)
                known = (low != high)[which]
                at = np.flatnonzero(~known)
                if len(at):
                    yield frame(x[at], d[at], s[at], [[v] for v in k[at].view(np.int64)], np.zeros(len(at), np.int32))
                rep = np.flatnonzero(low != high)
                if len(rep):
                    for ends in (low, high):
                        yield frame(values[rep], ends[rep], np.full(len(rep), -1), [[v] for v in k[first[rep]].view(np.int64)], np.zeros(len(rep), np.int32))
                    kd, ks = d[known], s[known]
                    at = _runs(kd, ks)
                    n = np.diff(np.r_[at, len(kd)]).astype(np.int32)
                    spread = mix(kd[at].astype(np.uint64) * np.uint64(1_000_003) + ks[at].astype(np.uint64))
                    yield frame(spread, kd[at], ks[at], [[] for _ in at], n)

    return run


def _merge(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Windows (doc, start, n) -> stretches (doc, s, e) of words, merged within each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                doc, start, n = pdf["doc"].to_numpy(), pdf["start"].to_numpy().astype(np.int64), np.maximum(pdf["n"].to_numpy(), 1)
                order = np.lexsort((start, doc))
                doc, start, end = doc[order], start[order], (start + n + least - 1)[order]
                # Ends only grow within a document once each is the largest so far; the offset keeps documents apart.
                rank = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]).astype(np.int64)])
                far = np.maximum.accumulate(end + rank * (1 << 40)) - rank * (1 << 40)
                at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])])
                yield pd.DataFrame({"doc": doc[at], "s": start[at], "e": far[np.r_[at[1:] - 1, len(doc) - 1]]})

    return run


def _hot_sketches(docs: DataFrame, least: int, chunk: int) -> np.ndarray:
    """The most frequent sketches, estimated on one document in HINT_SAMPLE; at most HOT_MOST come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Hashes()
        for pdf in batches:
            for doc, start, _, sketch in _pieces(pdf["doc"].to_numpy(), pdf["text"].tolist(), least, memo, chunk):
                at = _runs(doc, start, sketch)
                yield pd.DataFrame({"key": sketch[at].view(np.int64)})

    some = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(HINT_SAMPLE)) == 0).mapInPandas(run, "key long")
    rows = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HINT_SAMPLE >= HOT_ROWS).orderBy(F.desc("n"), "key").limit(HOT_MOST).collect()
    return np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64)


def shared_spans(df: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 40) -> DataFrame:
    """doc_id, start_word, n_words: the longest runs of words that lie in `least` or more consecutive words found in another document too.

    Words are runs of characters other than white space, compared exactly; `ident` must
    be a unique bigint. Null texts and texts of fewer than `least` words share nothing;
    a passage repeated only within one document is not shared. Other columns are
    ignored; an empty table gives no rows.

    Every window of `least` words is sketched by MinHash over its grams (one band of
    one row, so equal windows always collide), neighbouring windows with one sketch
    travel as one row, and windows that collide are verified by their own 64-bit hash:
    a window is shared if the rows of both its hashes (128 bits) name two documents. One
    shuffle by sketch, none of pairs; frequent sketches are settled before it (see _scan).
    """
    docs = df.select(F.col(ident).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("text is not null and doc is not null")
    hot = _hot_sketches(docs, least, CHUNK)
    rows = docs.mapInPandas(_scan(least, hot, CHUNK), "key long, doc long, start int, w array<long>, n int")
    by_key = Window.partitionBy("key")
    met = rows.withColumns({"lo": F.min("doc").over(by_key), "hi": F.max("doc").over(by_key)}).filter("lo <> hi or n > 0").drop("lo", "hi")
    each = met.select("key", "doc", "start", "n", F.posexplode_outer("w").alias("at", "x"))
    by_window = Window.partitionBy("key", "x")
    shared = each.withColumns({"lo": F.min("doc").over(by_window), "hi": F.max("doc").over(by_window)}).filter("(lo <> hi or n > 0) and start >= 0")
    stretches = shared.select("doc", (F.col("start") + F.coalesce("at", F.lit(0))).alias("start"), "n").mapInPandas(_merge(least), "doc long, s long, e long")
    in_order = Window.partitionBy("doc").orderBy("s", "e")
    before = F.max("e").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = stretches.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1)).withColumn("island", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = islands.groupBy("doc", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.select(F.col("doc").alias("doc_id"), F.col("s").alias("start_word"), (F.col("e") - F.col("s")).alias("n_words"))


def shared_share(df: DataFrame, spans: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_shared, share: how much of each document stands in other ones; an empty document has share 0."""
    total = df.select(F.col(ident).alias("doc_id"), F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")).cast("bigint").alias("n_words"))
    part = spans.groupBy("doc_id").agg(F.sum("n_words").alias("n_shared"))
    shared = F.coalesce("n_shared", F.lit(0))
    return total.join(part, "doc_id", "left").select("doc_id", "n_words", shared.alias("n_shared"), F.when(F.col("n_words") > 0, shared / F.col("n_words")).otherwise(0.0).alias("share"))
