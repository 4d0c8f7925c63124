"""Sets that may be alike, found among many through their rare items, without pairs of all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.session import cut

#: Groups into which items are hashed: the dimensions of the count vectors.
GROUPS = 64
#: Rows of one block that one task compares; larger blocks are split into pairs of parts.
BLOCK = 1 << 14
#: Points in a leaf of the R-tree. A block of up to two leaves is its own leaf: its points are compared without a tree above them.
LEAF = 32
FLAT = 2 * LEAF
#: Counts of a group that are kept as bits, one each; sets above WIDE items, whose counts are larger, carry their vector too.
STEPS = 3
WIDE = GROUPS * STEPS
#: Pairs of rows of a block that are looked at together.
AT_ONCE = 1 << 20
#: Buckets in which items are counted to order them, one byte each: least and most.
BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 24
#: Buckets that come to the driver as one row.
ROW = 1 << 16
#: Most rows of a table of large blocks that is broadcast; beyond, it is joined by shuffle.
MOST_BROADCAST = 100_000


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def large_blocks(rows: DataFrame, key: str, block: int, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, bool]:
    """(key, parts) of the blocks above `block` rows, and whether that table is small enough to broadcast.

    At most one row for every `block` rows there are; counts have a partial stage.
    """
    large = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block).select(key, F.ceil(F.col("m") / block).cast("int").alias("parts")))
    return large, large.limit(most_broadcast + 1).count() <= most_broadcast


def _packed(v: np.ndarray) -> bytes:
    """A count vector in one byte a group, or in eight where a count needs more."""
    return v.astype(np.uint8).tobytes() if v.max(initial=0) < 256 else v.astype(np.int64).tobytes()


def _unpacked(column: pd.Series) -> np.ndarray:
    """The count vectors of a column of _packed, one row each."""
    out = np.zeros((len(column), GROUPS), np.int32)
    wide = column.map(len).to_numpy() != GROUPS
    if not wide.all():
        out[~wide] = np.frombuffer(b"".join(column[~wide]), dtype=np.uint8).reshape(-1, GROUPS)
    if wide.any():
        out[wide] = np.frombuffer(b"".join(column[wide]), dtype=np.int64).reshape(-1, GROUPS)
    return out


def _bucket(tok: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(tok.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _coded(n: np.ndarray) -> np.ndarray:
    """Counts in one byte that keeps their order: 0 to 16 as they are, larger ones by their logarithm."""
    return np.where(n <= 16, n, np.minimum(255, 16 + np.floor(5 * np.log2(np.maximum(n, 16) / 16)))).astype(np.uint8)


def _buckets(sets: int) -> int:
    """Four buckets a set, within the bounds: too few would mix rare items with frequent ones, and blocks of frequent ones are large."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (4 * sets).bit_length()))


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many (set, item) rows fall in each bucket of items, over all sets, coded in one byte each.

    A table of MOST_BUCKETS bytes at most, whatever the corpus: each task adds up its own
    rows, the sums meet by bucket, and come to the driver as blocks of bytes. It orders
    items from rare to frequent, and tells those that no other set holds; any order
    gives the same result.
    """
    buckets = _buckets(sets.count())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            if len(pdf):
                held.append(_bucket(np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["sh"]]), buckets))
                size += len(held[-1])
            if size > 1 << 23:
                yield summed(held)
                held, size = [], 0
        if held:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pd.DataFrame:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"bucket": at.astype(np.int32), "n": n})

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(ROW, np.uint8)
        out[pdf["bucket"].to_numpy() % ROW] = _coded(pdf["n"].to_numpy())
        return pd.DataFrame({"part": [key[0]], "block": [out.tobytes()]})

    sums = sets.select("sh").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    blocks = sums.withColumn("part", F.floor(F.col("bucket") / ROW).cast("int")).groupBy("part").applyInPandas(block, "part int, block binary").collect()
    table = np.zeros((buckets // ROW, ROW), np.uint8)
    for r in blocks:
        table[r["part"]] = np.frombuffer(r["block"], np.uint8)
    return table.reshape(-1)


def _tree(points: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bulk-load: order of the points, starts of leaves, upper corners, least size per leaf.

    Points are tiled by size, then within a tile by the coordinate that varies most.
    """
    order = np.argsort(n, kind="stable")
    tile = LEAF * max(1, int(np.sqrt(len(n) / LEAF)))
    axis = int(points.var(axis=0).argmax())
    order = np.concatenate([o[np.argsort(points[o, axis], kind="stable")] for o in np.split(order, range(tile, len(n), tile))])
    starts = np.arange(0, len(n), LEAF)
    return order, starts, np.maximum.reduceat(points[order], starts, axis=0), np.minimum.reduceat(n[order], starts)


def _meets(inter2: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an overlap of inter2 can give a similarity of num/den: inter * (den + num) >= num * (na + nb)."""
    return inter2 * (den + num) >= num * (na + nb)


def _search(qv: np.ndarray, qn: np.ndarray, pv: np.ndarray, pn: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) whose summed coordinate minima allow the similarity, through an R-tree over the points."""
    order, starts, corner, least = _tree(pv, pn)
    left, right = [], []
    for at in range(0, len(qn), 256):
        q, m = qv[at : at + 256].astype(np.int32), qn[at : at + 256]
        bound = np.minimum(q[:, None, :], corner[None].astype(np.int32)).sum(2)
        qi, leaf = np.nonzero(_meets(bound, m[:, None], least[None], num, den))
        spread = np.minimum(LEAF, len(pn) - starts[leaf])
        pi = order[np.repeat(starts[leaf], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)]
        qi = np.repeat(qi, spread)
        for lo in range(0, len(qi), 1 << 18):
            a, b = qi[lo : lo + (1 << 18)], pi[lo : lo + (1 << 18)]
            ok = _meets(np.minimum(q[a], pv[b]).sum(1), m[a], pn[b], num, den)
            left.append(a[ok] + at)
            right.append(b[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _bits(v: np.ndarray) -> list[np.ndarray]:
    """Count vectors as STEPS words of GROUPS bits each: the groups that hold at least 1, 2, ... items."""
    return [np.packbits(v >= k, axis=1, bitorder="little").view(np.uint64).reshape(-1) for k in range(1, STEPS + 1)]


def _meeting(block: np.ndarray, n: np.ndarray, rest: np.ndarray, side: np.ndarray, bits: list[np.ndarray], num: int, den: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block that may be alike, as positions; rows are sorted by block, then size n.

    `rest` counts the items from the block's on, in the order from rare to frequent.
    Two alike sets are found in the block of their first common item, so what they share
    lies in the rest of both. For the smaller one, its size and rest leave a range of sizes,
    which is a stretch of rows; only these are looked at, in steps of AT_ONCE pairs, and
    the rest of the larger one and the count vectors bound the overlap. Rows of side 1 meet
    those of side 2 only; rows to skip do not meet each other.
    """
    n, rest = n.astype(np.int64), rest.astype(np.int64)
    span = int(n.max(initial=0)) + 1
    key = block * span + n
    top = np.minimum(n * den // num, rest * (den + num) // num - n)
    after = np.arange(1, len(n) + 1)
    count = np.maximum(0, np.searchsorted(key, block * span + np.minimum(top, span - 1), "right") - after)
    over = rest * (den + num) - num * n
    extra = n - sum(np.bitwise_count(x).astype(np.int64) for x in bits)
    ends = np.cumsum(count)
    left, right, lo = [], [], 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
        c = count[lo:hi]
        a = np.repeat(np.arange(lo, hi), c)
        b = np.arange(len(a)) + np.repeat(after[lo:hi] - (np.cumsum(c) - c), c)
        ok = (over[b] >= num * n[a]) & ((side[a] != side[b]) | (side[a] == 0)) & ~(skip[a] & skip[b])
        a, b = a[ok], b[ok]
        common = np.minimum(extra[a], extra[b])
        for x in bits:
            common += np.bitwise_count(x[a] & x[b])
        ok = _meets(common, n[a], n[b], num, den)
        left.append(a[ok])
        right.append(b[ok])
        lo = hi
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _candidates(num: int, den: int, flat: int):
    """mapInPandas function: rows sorted by block and size -> pairs that survive size, position and count-vector bounds."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, side = pdf["no"].to_numpy(), pdf["n"].to_numpy().astype(np.int64), pdf["side"].to_numpy()
        tok = pdf["tok"].to_numpy()
        first = np.r_[True, tok[1:] != tok[:-1]]
        block = np.cumsum(first) - 1
        # In large blocks the long sets, which bits do not tell apart, meet through a tree over their vectors.
        wide = pdf["vec"].notna().to_numpy()
        treed = wide & (np.bincount(block, wide)[block] > flat)
        a, b = _meeting(block, n, pdf["rest"].to_numpy(), side, [pdf[f"bits{k}"].to_numpy().view(np.uint64) for k in range(STEPS)], num, den, treed)
        if wide.any():
            at = np.cumsum(wide) - 1
            vec = _unpacked(pdf["vec"][wide])
            both = wide[a] & wide[b]
            ok = ~both
            ok[both] = _meets(np.minimum(vec[at[a[both]]], vec[at[b[both]]]).sum(1, dtype=np.int64), n[a[both]], n[b[both]], num, den)
            left, right = [a[ok]], [b[ok]]
            for g in np.unique(block[treed]):
                rows = np.flatnonzero(treed & (block == g))
                q, p = (rows, rows) if side[rows[0]] == 0 else (rows[side[rows] == 1], rows[side[rows] == 2])
                if not len(q) or not len(p):
                    continue
                x, y = _search(vec[at[q]], n[q], vec[at[p]], n[p], num, den)
                x, y = q[x], p[y]
                ok = (x != y) & (np.minimum(n[x], n[y]) * den >= num * np.maximum(n[x], n[y]))
                left.append(x[ok])
                right.append(y[ok])
            a, b = np.concatenate(left), np.concatenate(right)
        a, b = ids[a], ids[b]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if keep is None else pd.concat([keep, pdf], ignore_index=True)
            tail = (pdf["tok"] == pdf["tok"].iloc[-1]).to_numpy()
            done, keep = pdf[~tail].reset_index(drop=True), pdf[tail]
            if len(done):
                yield of(done)
        if keep is not None and len(keep):
            yield of(keep.reset_index(drop=True))

    return run


def meet(sets: DataFrame, num: int, den: int, block: int = BLOCK, flat: int = FLAT, wide: int = WIDE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """a, b: pairs of sets, a < b, whose Jaccard similarity may be num/den or more, each once; none that reaches it is missing.

    `sets` has no, a long of its own for each set, and sh, its distinct items as longs; it is
    read several times, so it should be cut. Items are ordered by how many items of all
    sets fall in their bucket, so rare ones come first; two similar sets share an item among the first few of each
    (the prefix), so they meet in the blocks of those. In a block, sizes, positions and vectors
    of group counts bound the overlap. Blocks above `block` rows are split into pairs of parts.
    """
    weights = sets.sparkSession.sparkContext.broadcast(_bucket_counts(sets))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["sh"].map(len).to_numpy().astype(np.int64)
            tok, owner = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["sh"]]), np.repeat(np.arange(len(pdf)), n)
            weight = weights.value[_bucket(tok, len(weights.value))]
            order = np.lexsort((tok, weight, owner))
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
            # What no other class can hold meets nobody; it keeps its place.
            keep = (pos < (n - -(-n * num // den) + 1)[owner]) & (weight[order] > 1)
            at = np.searchsorted(owner[keep], np.arange(1, len(pdf)))
            vec = np.bincount(owner * GROUPS + tok % GROUPS, minlength=len(pdf) * GROUPS).reshape(len(pdf), GROUPS)
            bits = {f"bits{k}": x.view(np.int64) for k, x in enumerate(_bits(vec))}
            yield pd.DataFrame({"no": pdf["no"], "n": n.astype(np.int32), "toks": np.split(tok[order][keep], at), "rests": np.split((n[owner] - pos)[keep].astype(np.int32), at), **bits, "vec": [_packed(v) if m > wide else None for v, m in zip(vec, n)]})

    about = ["no", "n", "rest", *[f"bits{k}" for k in range(STEPS)], "vec"]
    compact = cut(sets.filter(F.size("sh") > 0).select("no", "sh").mapInPandas(prefixes, "no long, n int, toks array<long>, rests array<int>, " + "".join(f"bits{k} long, " for k in range(STEPS)) + "vec binary"))
    rows = compact.select("*", F.inline(F.arrays_zip(F.col("toks").alias("tok"), F.col("rests").alias("rest")))).select("tok", *about)
    # Blocks above BLOCK rows are told apart before anything moves; a part meets itself, and other parts under keys of their own.
    large, few = large_blocks(rows, "tok", block, most_broadcast)
    marked = rows.join(F.broadcast(large) if few else large, "tok", "left")
    small = marked.filter("parts is null").select("tok", F.lit(0).cast("byte").alias("side"), *about)
    split = marked.filter("parts is not null").withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int"))
    split = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("o"), 0).when(F.col("part") < F.col("o"), 1).otherwise(2).cast("byte")
    split = split.select(F.xxhash64("tok", F.least("part", "o"), F.greatest("part", "o")).alias("tok"), side.alias("side"), *about)
    by_block = small.unionByName(split).repartition("tok").sortWithinPartitions("tok", "n")
    return by_block.mapInPandas(_candidates(num, den, flat), "a long, b long").distinct()
