"""Texts into packs of fixed capacity, by bin completion.

A text longer than a pack fills packs of its own; what is left of it is an item like any other. Items are dealt by hash into
shards of about ``SHARD`` items (a shard wastes at most one pack more than all items together would), and each shard is solved
apart, by branch and bound: a node is the largest item left, its branches are the undominated fillings of the room beside it, those
with the least waste first. Best-fit decreasing is the first incumbent; a branch is cut when its waste, or the bound L2 of what it
leaves, can't beat the incumbent; the search ends at the lower bound, when all branches are done, or when its budget is spent.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 20_000
#: Bounds of the work, not of the result (every item is placed whatever they are): fillings looked at around one item, fillings kept
#: to return to, and fillings looked at in all after the first way down (eight times as many for few items). None for ``nodes`` and ``budget`` gives the exact search.
NODES, BRANCHES, BUDGET = 160, 16, 400_000
#: Items left below which no bound but the budget holds.
SMALL = 150
#: Subsets of a filling's items that are tried for dominance: all of up to so many items, else single items and pairs.
SUBSETS = 7


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Packs that any placement needs: the bound L2. For each a up to half the capacity, items over ``capacity - a`` and over half
    stand alone or with small ones, and what items from a to half don't find room beside them needs packs of its own."""
    order = sorted(sizes)
    if not order:
        return 0
    before = [0, *accumulate(order)]
    half = bisect_right(order, capacity // 2)
    best = -(-before[-1] // capacity)
    for a in sorted({0, *order[:half]}):
        alone = bisect_right(order, capacity - a)
        large, mid = len(order) - half, before[half] - before[bisect_left(order, a)]
        room = (alone - half) * capacity - (before[alone] - before[half]) if alone > half else 0
        best = max(best, large + max(0, -(-(mid - room) // capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing."""
    bins: list[list[int]] = []
    by_rest: dict[int, list[int]] = {}
    rests: list[int] = []
    for s in sorted(sizes, reverse=True):
        at = bisect_right(rests, s - 1)
        if at < len(rests):
            rest = rests[at]
            k = by_rest[rest].pop()
            if not by_rest[rest]:
                del by_rest[rest]
                rests.pop(at)
        else:
            k, rest = len(bins), capacity
            bins.append([])
        bins[k].append(s)
        left = rest - s
        if left:
            if left not in by_rest:
                insort(rests, left)
                by_rest[left] = []
            by_rest[left].append(k)
    return bins


class _Pool:
    """Sizes left, with their counts."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.order = sorted(self.count)
        self.size = len(sizes)

    def items(self) -> list[int]:
        return [s for s in self.order for _ in range(self.count[s])]

    def take(self, s: int) -> None:
        self.size -= 1
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]
            self.order.pop(bisect_right(self.order, s) - 1)

    def put(self, s: int) -> None:
        self.size += 1
        if s not in self.count:
            insort(self.order, s)
            self.count[s] = 0
        self.count[s] += 1


def dominated(pool: _Pool, chosen: list[tuple[int, int]], slack: int) -> bool:
    """Whether some of a filling's items could give way to one larger item of the pool: then whatever packing uses the filling can
    use the other one. With ``chosen`` as sizes and numbers. The empty subset tells fillings that leave room for an item."""
    used = dict(chosen)
    items = [s for s, m in chosen for _ in range(m)]
    if len(items) <= SUBSETS:
        sums = {(0, 0)}
        for s in items:
            sums |= {(n + 1, t + s) for n, t in sums}
    else:
        sums = {(0, 0)} | {(1, s) for s in used} | {(2, s + t) for s in used for t in used if s < t or s == t and used[s] > 1}
    for n, total in sums:
        k = bisect_left(pool.order, total) if n > 1 else bisect_right(pool.order, total)
        while k < len(pool.order) and pool.order[k] <= total + slack:
            x = pool.order[k]
            if pool.count[x] > used.get(x, 0):
                return True
            k += 1
    return False


def fillings(pool: _Pool, room: int, most: int, nodes: int | None, want: int | None = 1) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """Undominated fillings of ``room`` that waste at most ``most``, as ``(waste, [(size, number)])``, the least waste first, and the
    number of nodes seen. Up to ``want`` of those met within ``nodes``; None for all. Larger items are tried first."""
    best: list[tuple[int, list[tuple[int, int]]]] = []
    seen, smallest = 0, pool.order[0] if pool.order else 0

    def keep(waste: int, chosen: list[tuple[int, int]]) -> bool:
        if waste <= most and (want is None or len(best) < want or waste < best[-1][0]) and not dominated(pool, chosen, waste):
            insort(best, (waste, list(chosen)), key=lambda x: x[0])
            if want is not None:
                del best[want:]
        return want is not None and len(best) == want and best[-1][0] == 0

    def search(room: int, k: int, chosen: list[tuple[int, int]]) -> bool:
        nonlocal seen
        seen += 1
        k = min(k, bisect_right(pool.order, room) - 1)
        if nodes is not None and k >= 0 and pool.order[k] != room:
            at = bisect_right(pool.order, room // 2) - 1  # a pair that fills the room to the last token, if one is near its half
            for j in range(min(k, at), max(-1, min(k, at) - 4), -1):
                s = pool.order[j]
                if room - s in pool.count and room - s <= pool.order[k] and (2 * s < room or pool.count[s] > 1) and keep(0, [*chosen, (room - s, 1), (s, 1)] if 2 * s < room else [*chosen, (s, 2)]):
                    return True
        whole = room
        while k >= 0:
            if nodes is not None and seen >= nodes:
                break
            s = pool.order[k]
            if most < room - s < smallest and pool.order[k] > smallest and room - s < s:
                # no item fits beside it and too much is wasted; it is the same for all that are smaller, down to where one fits
                k = bisect_right(pool.order, room - smallest, 0, k) - 1
                continue
            for m in range(min(pool.count[s], room // s), 0, -1):
                if most < room - m * s < smallest:
                    continue
                chosen.append((s, m))
                done = search(room - m * s, k - 1, chosen) if room > m * s else keep(0, chosen)
                chosen.pop()
                if done:
                    return True
                if nodes is not None and seen >= nodes:
                    break
            k -= 1
        return keep(whole, chosen)

    search(room, len(pool.order) - 1, [])
    return best, seen


def complete(sizes: list[int], capacity: int, nodes: int | None = NODES, budget: int | None = BUDGET) -> list[list[int]]:
    """Packs of ``sizes`` (each from 1 to ``capacity``). With None for ``nodes`` and ``budget`` as few as there can be."""
    incumbent, least = best_fit(sizes, capacity), lower_bound(sizes, capacity)
    if len(incumbent) <= least:
        return incumbent
    total = sum(sizes)
    spare = (len(incumbent) - 1) * capacity - total  # what a better packing may waste
    pool, waste, spent, first_way = _Pool(sizes), 0, 0, True
    most = budget if budget is None or len(sizes) > 2 * SMALL else 8 * budget
    #: of each open pack: its largest item, its filling, what that wastes, and the fillings to try next (None: not looked for yet)
    way: list[tuple[int, list[tuple[int, int]], int, list | None]] = []

    def go(top: int, filling: list[tuple[int, int]], wasted: int, later: list | None) -> None:
        nonlocal waste
        for s, m in filling:
            for _ in range(m):
                pool.take(s)
        way.append((top, filling, wasted, later))
        waste += wasted

    while True:
        if not pool.order:
            first_way = False
            if len(way) < len(incumbent):
                incumbent = [[top, *(s for s, m in filling for _ in range(m))] for top, filling, _, _ in way]
                spare = (len(incumbent) - 1) * capacity - total
                if len(incumbent) <= least:
                    break
        elif waste <= spare and (pool.size > 2 * SMALL or len(way) + lower_bound(pool.items(), capacity) < len(incumbent)):
            top = pool.order[-1]
            pool.take(top)
            found, seen = fillings(pool, capacity - top, spare - waste, nodes if first_way or pool.size > SMALL else None)
            spent += 0 if first_way else seen
            if found:
                go(top, found[0][1], found[0][0], None)
                continue
            pool.put(top)
        first_way = False
        while way:  # back to the last pack that has another filling
            top, filling, wasted, later = way.pop()
            waste -= wasted
            for s, m in filling:
                for _ in range(m):
                    pool.put(s)
            if later is None:
                few = nodes is None or pool.size <= SMALL  # the last packs, in which the waste ends up, are searched through
                left = nodes if not few else None if most is None else max(1, most - spent)
                found, seen = fillings(pool, capacity - top, spare - waste, left, None if few else BRANCHES)
                spent += seen
                later = [f for f in reversed(found) if f[1] != filling]
            while later and later[-1][0] > spare - waste:
                later.pop()
            if later:
                w, chosen = later.pop()
                go(top, chosen, w, later)
                break
            pool.put(top)
        if not way or most is not None and spent > most:
            break
    return incumbent


def _solve(t: pa.Table, nodes: int | None, budget: int | None) -> pa.Table:
    capacity, shard, name = t["capacity"][0].as_py(), t["shard"][0].as_py(), t["pack_name"][0].as_py()
    waiting: dict[int, list[int]] = {}
    ids, pieces, starts, sizes = (t[c].to_pylist() for c in ("doc_id", "piece", "first_token", "n_tokens"))
    for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, pieces[k]), reverse=True):
        waiting.setdefault(sizes[k], []).append(k)
    rows = []
    for number, pack in enumerate(complete(sizes, capacity, nodes, budget)):
        fill = sum(pack)
        rows += [(waiting[s].pop(), f"{name}-{shard}-{number}", fill) for s in pack]
    order = [r[0] for r in rows]
    return pa.table({
        "pack_name": pa.array([name] * len(rows), pa.string()), "pack_id": pa.array([r[1] for r in rows], pa.string()), "doc_id": pa.array([ids[k] for k in order], pa.int64()),
        "piece": pa.array([pieces[k] for k in order], pa.int32()), "first_token": pa.array([starts[k] for k in order], pa.int32()), "n_tokens": pa.array([sizes[k] for k in order], pa.int32()),
        "fill_tokens": pa.array([r[2] for r in rows], pa.int32()),
    })


PACK_SCHEMA = "pack_name string, pack_id string, doc_id bigint, piece int, first_token int, n_tokens int, fill_tokens int"


def pack(sized: DataFrame, packs: DataFrame, shard: int = SHARD, nodes: int | None = NODES, budget: int | None = BUDGET) -> DataFrame:
    """Every text of ``sized`` (``doc_id, n_tokens``) in a pack of each row of ``packs`` (``pack_name, capacity_tokens``).

    One row per text and pack, with the piece (from 1) and the first token (from 0) that stand there and the pack's fill. Texts of
    no tokens need no place and give no row; ties are settled by id; repeated rows are placed each; a null or non-positive
    capacity gives no packs; empty tables give none. ``nodes`` and ``budget`` bound the search in a shard (see ``complete``).
    """
    n = sized.count()
    shards = max(1, -(-n // shard))
    kinds = packs.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("packs is a table of parameters; it has over 1000 rows")
    wanted = F.array(*(F.struct(F.lit(k[0]).cast("string").alias("pack_name"), F.lit(int(k[1])).alias("capacity")) for k in kinds))
    if not kinds:
        return sized.sparkSession.createDataFrame([], PACK_SCHEMA)
    jobs = sized.where("n_tokens > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_tokens", F.inline(wanted))
    pieces = jobs.select("pack_name", "capacity", "doc_id", F.posexplode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.col("capacity"))).alias("k", "first_token"), "n_tokens")
    pieces = pieces.select("pack_name", "capacity", "doc_id", (F.col("k") + 1).alias("piece"), "first_token", F.least("capacity", F.col("n_tokens") - F.col("first_token")).alias("n_tokens"))
    whole = pieces.where("n_tokens = capacity").select(
        "pack_name", F.concat_ws("-", "pack_name", F.lit("w"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("pack_id"), "doc_id", "piece", "first_token", "n_tokens", F.col("capacity").alias("fill_tokens"))
    # rows without an id are dealt out by their place in their partition, so that they don't all meet in one shard
    rest = pieces.where("n_tokens < capacity").withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", "row"), "piece"), F.lit(shards)).cast("int")).drop("row")
    return whole.unionByName(rest.groupBy("pack_name", "shard").applyInArrow(lambda t: _solve(t, nodes, budget), PACK_SCHEMA))


def fill_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per kind of pack: packs, pieces, tokens, the share of all room that is filled, and the packs that the sum of tokens needs."""
    per = placed.groupBy("pack_name").agg(F.countDistinct("pack_id").alias("n_packs"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return packs.join(per, "pack_name", "left").select(
        "pack_name", "capacity_tokens", F.coalesce("n_packs", F.lit(0)).alias("n_packs"), F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.round(F.try_divide(F.col("n_tokens"), F.col("n_packs") * F.col("capacity_tokens")), 6).alias("fill"), F.ceil(F.try_divide(F.col("n_tokens"), F.col("capacity_tokens"))).alias("needed_packs"))
