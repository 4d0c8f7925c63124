"""Filling packs of fixed capacity with documents, by a grouping genetic algorithm on islands."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.session import cut

#: Items that one island packs: SHARD on average, more where they would fill fewer than LEAST_BINS bins (that depends on the
#: capacity, not on how much data there is), at most MOST_ITEMS.
SHARD, LEAST_BINS, MOST_ITEMS = 2000, 64, 1_000_000
ISLANDS, EPOCHS = 2, 2
POPULATION, CHILDREN, ELITES = 4, 12, 2
#: One bin in so many of a shard, the emptiest ones, is opened again and packed together with those of other shards.
REOPEN = 16
#: Most rows of the table of pack sizes.
MOST_PACKS = 1000


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray, fills: list[int]) -> np.ndarray:
    """Put the items of `order` one after another into the fullest bin that holds them, opening bins as needed.

    `bins` (changed and returned) has the bin of each item, -1 for none; `fills` the
    fill of each bin so far.
    """
    room = sorted((capacity - f, b) for b, f in enumerate(fills))
    for i in order:
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        fills[b] += size
        bins[i] = b
        insort(room, (left - size, b))
    return bins


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: fewer bins, and fuller ones beside emptier ones, score higher."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return float((fill**2).mean()) if len(fill) else 1.0


def settle(child: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Put the items of no bin (-1) back: where a larger free item fits in the place of a smaller one it goes there, then best fit, largest first.

    Each replacement fills a bin better and leaves a smaller item to place.
    """
    kept = child >= 0
    labels, child[kept] = np.unique(child[kept], return_inverse=True)
    fills = np.bincount(child[kept], weights=sizes[kept], minlength=len(labels)).astype(np.int64)
    free = sorted(np.flatnonzero(~kept), key=lambda i: (-sizes[i], i))
    if len(free) <= max(8, len(child) // 8):  # where more is free, best fit has small items enough
        for k, i in enumerate(free):
            room = np.where(child >= 0, (capacity - fills)[np.where(child >= 0, child, 0)], -1) if len(fills) else np.full(len(child), -1)
            gain = sizes[i] - sizes
            gain = np.where((gain > 0) & (gain <= room), gain, 0)
            out = int(gain.argmax())
            if gain[out] > 0:
                child[i], child[out] = child[out], -1
                fills[child[i]] += gain[out]
                free[k] = out
        free.sort(key=lambda i: (-sizes[i], i))
    return best_fit(sizes, np.array(free, dtype=np.int64), capacity, child, fills.tolist())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with well-filled whole bins of b.

    The bins of b are injected whole, bins of a that share an item with them go, and so
    do the emptiest bins of a and some others by lot; the items displaced so are put back
    by replacement and best fit.
    """
    fill = np.bincount(b, weights=sizes)
    chance = rng.random(len(fill)) < 0.05 * (fill / capacity) ** 8
    inject = chance[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[inject]] = True
    own = np.bincount(a, weights=sizes)
    few = min(len(own) - 1, 4)
    hit[np.argsort(own, kind="stable")[:few]] = True
    hit[rng.integers(0, len(own), few)] = True
    child = np.where(inject, b + len(hit), a)
    child[hit[a] & ~inject] = -1
    return settle(child, sizes, capacity)


def evolve(sizes: np.ndarray, capacity: int, seed: int, start: list[np.ndarray]) -> list[np.ndarray]:
    """The best packings after one epoch on one island, best first.

    Stops early where the number of bins cannot be lower, as it equals the total size
    over the capacity, rounded up.
    """
    rng = np.random.default_rng(seed)
    n = len(sizes)
    least = max(1, -(-int(sizes.sum()) // capacity))
    down = np.argsort(-sizes, kind="stable")
    pool = list(start) or [best_fit(sizes, down, capacity, np.full(n, -1, np.int64), [])]
    done = lambda p: int(p.max()) + 1 <= least
    while len(pool) < POPULATION and not any(map(done, pool)):
        noisy = np.argsort(-sizes * (1 + 0.15 * rng.random(n)), kind="stable")
        pool.append(best_fit(sizes, noisy, capacity, np.full(n, -1, np.int64), []))
    rank = lambda p, k: (int(p.max()) + 1, -fitness(p, sizes, capacity), k)
    scored = sorted(((rank(p, k), p) for k, p in enumerate(pool)), key=lambda x: x[0])
    for k in range(CHILDREN):
        if done(scored[0][1]):
            break
        i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = crossover(scored[min(i, j)][1], scored[max(i, j)][1], sizes, capacity, rng)
        scored = sorted([*scored, (rank(child, len(pool) + k), child)], key=lambda x: x[0])[:POPULATION]
    return [p for _, p in scored[:ELITES]]


def reopened(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Whether each item lies in one of the emptiest bins, one in REOPEN of them and one at least; full bins stay."""
    fill = np.bincount(bins, weights=sizes)
    chosen = np.zeros(len(fill), bool)
    chosen[np.argsort(fill, kind="stable")[: max(1, len(fill) // REOPEN)]] = True
    return (chosen & (fill < capacity))[bins]


def pack(items: DataFrame, packs: DataFrame, ident: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """pack, bin, doc_id, piece, tokens, fill, capacity: where every piece of every document lies, for each row of `packs`.

    `items` has a unique bigint id and a size; null and negative sizes count as 0.
    `packs` has pack and capacity_tokens, at most MOST_PACKS rows (more raise an error);
    packs without a name or a positive capacity are left out. A document larger than the capacity is
    split into full pieces, which fill bins of their own, and a remainder; no other document
    is split. piece is numbered from 0. Items of size 0 have one piece. Other columns are
    ignored; an empty table gives no rows.

    Items are spread by hash over shards of bounded size, so no group grows with the data.
    ISLANDS populations evolve for each shard, exchange their elites after each of EPOCHS
    epochs, and the best packing of a shard stands. The emptiest bins of all shards are then
    opened and packed together, in ever fewer shards, until one holds what is left: so what
    shards lose at their ends is lost once, not once for each of them.
    """
    sized = items.select(F.col(ident).cast("bigint").alias("doc"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size")).filter("doc is not null")
    caps = packs.filter("capacity_tokens > 0 and pack is not null").groupBy("pack").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    table = [(r["pack"], r["capacity"]) for r in caps.limit(MOST_PACKS + 1).collect()]
    if len(table) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} pack sizes")
    if not table:
        return sized.select(F.lit("").alias("pack"), F.lit("").alias("bin"), F.col("doc").alias("doc_id"), *[F.lit(0).cast("bigint").alias(c) for c in ("piece", "tokens", "fill", "capacity")]).limit(0)
    known = F.array(*[F.struct(F.lit(p).cast("string").alias("pack"), F.lit(c).cast("bigint").alias("capacity")) for p, c in table])
    each = sized.select("doc", "size", F.inline(known)).withColumns({"full": F.floor(F.col("size") / F.col("capacity")), "rest": F.col("size") % F.col("capacity")})
    whole = each.filter("full > 0").select("pack", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"), "doc", F.col("capacity").alias("tokens"), "capacity")
    done = [whole.select("pack", F.concat(F.lit("f"), F.col("doc").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("bin"), F.col("doc").alias("doc_id"), "piece", "tokens", F.col("tokens").alias("fill"), "capacity")]
    loose = each.filter("rest > 0 or full = 0").select("pack", "capacity", "doc", F.col("rest").alias("size"), F.col("full").alias("piece"))
    level, before = 0, {}
    while True:
        stats = {r["pack"]: (r["n"], r["t"], r["capacity"]) for r in loose.groupBy("pack", "capacity").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t")).collect()}
        if not stats:
            break
        # What does not shrink (a shard that fills no pack, at MOST_ITEMS) is packed once and left so.
        shards = {p: _shards(*x) for p, x in stats.items()}
        final = {p: k == 1 or stats[p][0] > 0.5 * before.get(p, float("inf")) for p, k in shards.items()}
        before = {p: x[0] for p, x in stats.items()}
        placed = cut(_packed(loose, shards, level))
        over = [p for p, end in final.items() if end]
        stays = (F.col("pack").isin(over) if over else F.lit(False)) | ~F.col("open")
        at = ["pack", "shard", "b"]
        kept = placed.filter(stays)
        fills = kept.groupBy(*at).agg(F.sum("size").alias("fill"))
        name = F.concat(F.lit(f"s{level}."), F.col("shard").cast("string"), F.lit("."), F.col("b").cast("string"))
        done.append(kept.join(fills, at).select("pack", name.alias("bin"), F.col("doc").alias("doc_id"), "piece", F.col("size").alias("tokens"), "fill", "capacity"))
        if all(final.values()):
            break
        loose, level = placed.filter(~stays).select("pack", "capacity", "doc", "size", "piece"), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _shards(n: int, total: int, capacity: int) -> int:
    """Into how many shards n items of a total size go."""
    wanted = LEAST_BINS * capacity * n / total if total else SHARD
    return max(1, round(n / min(MOST_ITEMS, max(SHARD, wanted))))


def _packed(loose: DataFrame, shards: dict[str, int], level: int) -> DataFrame:
    """pack, capacity, shard, b, doc, size, piece, open: the items with their bin, and whether it is one to be opened again."""
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p, k in shards.items() for x in (p, k)]), "pack"), F.lit(1))
    of = loose.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), "doc", "piece"), parts).cast("int"))
    state = of.groupBy("pack", "capacity", "shard").agg(F.array_sort(F.collect_list(F.struct("doc", "size", "piece"))).alias("items"))
    schema = "pack string, capacity bigint, shard int, island int, items array<struct<doc:bigint,size:bigint,piece:bigint>>, elites array<array<int>>, open array<boolean>, bins int, score double"

    def epoch(number: int):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    sizes = np.array([x["size"] for x in r.items], dtype=np.int64)
                    start = [np.asarray(e, dtype=np.int64) for e in (r.elites if r.elites is not None else [])]
                    seed = ((level * 1009 + r.shard) * 1009 + r.island) * 31 + number
                    best = evolve(sizes, int(r.capacity), seed, start)
                    out.append((r.pack, r.capacity, r.shard, r.island, r.items, [b.astype(np.int32) for b in best], reopened(best[0], sizes, int(r.capacity)), int(best[0].max()) + 1, fitness(best[0], sizes, int(r.capacity))))
                yield pd.DataFrame(out, columns=["pack", "capacity", "shard", "island", "items", "elites", "open", "bins", "score"])

        return run

    islands = state.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("elites", F.expr("cast(null as array<array<int>>)"))
    for number in range(EPOCHS):
        if number:
            # Migration: the elites of a shard's islands meet, and each island starts from its own and its neighbour's.
            # The group has ISLANDS rows.
            met = islands.groupBy("pack", "capacity", "shard").agg(F.any_value("items").alias("items"), F.array_sort(F.collect_list(F.struct("island", "elites"))).alias("all"))
            own = lambda k: F.element_at("all", k)["elites"]
            islands = met.select("pack", "capacity", "shard", "items", F.posexplode(F.array(*[F.concat(own(i + 1), own((i - 1) % ISLANDS + 1)) for i in range(ISLANDS)])).alias("island", "elites"))
        islands = islands.select("pack", "capacity", "shard", "island", "items", "elites").repartition("pack", "shard", "island").mapInPandas(epoch(number), schema)
    best = islands.groupBy("pack", "capacity", "shard").agg(F.max_by(F.struct("items", F.element_at("elites", 1).alias("bins"), "open"), F.struct(-F.col("bins"), "score", -F.col("island"))).alias("x"))
    each = best.select("pack", "capacity", "shard", F.inline(F.arrays_zip(F.col("x.items").alias("item"), F.col("x.bins").alias("b"), F.col("x.open").alias("open"))))
    return each.select("pack", "capacity", "shard", "b", "item.doc", "item.size", "item.piece", "open")
