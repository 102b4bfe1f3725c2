"""The k most similar vectors of every vector: a forest of random-projection trees, searched through one shared priority queue.

1. Copies are folded first, those that differ by a power of two in length too, so a direction that stands in a third of all rows is
   one point with its first ids.
2. The trees are fitted on a bounded sample (``SAMPLE`` points; the only part that doesn't see all rows): a node's plane lies
   between two drawn points, at the median, so leaves are even. Below the fitted depth further planes follow, as many as the
   number of points asks for, so leaves keep their size at any scale. Every point is put into a leaf of every tree.
3. A point is searched in its own leaves and in ``probes`` more. All trees share one queue of branches not taken, by their distance:
   the nearest is popped and followed to its leaf, and the branches left beside that way are pushed in turn.
4. A leaf is one small matrix product; what passes it is ranked by the exact cosine in double precision. Points that no plane can
   split stand in parts; in the first tree each is compared with all parts of its leaf, block by block, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carillon.operators.skew import first_k, heavy_keys, lookup_join
from carillon.session import StageLog

#: Points on which trees are fitted, whatever the size of the table: 8 MB at 64 dimensions.
SAMPLE = 32_768
FITTED_LEAF = 64  #: sample points in a fitted leaf, at least
LEAF = 384  #: points in a leaf, about
PARTS = 1 << 14  #: parts of a leaf that no plane splits, at most


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, vec``: vectors of exactly ``dim`` finite numbers that aren't all zero, as little-endian float32 bytes, scaled by the power of
    two that brings the largest number between 1/2 and 1 where that loses nothing: cosines stay the same to the last bit. A null id
    or vector, another length, NaN and infinity drop out. Other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            whole = np.asarray(lists.value_lengths().fill_null(-1)) == dim
            if lists.null_count:
                whole &= np.asarray(lists.is_valid())
            whole &= np.asarray(b.column("id").is_valid())
            kept = lists.filter(pa.array(whole))
            flat = kept.flatten()
            x = np.asarray(flat.fill_null(float("nan")), dtype="<f4").reshape(-1, dim) + np.float32(0)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = np.ascontiguousarray(x[good])
            if len(x):
                power = -np.frexp(np.abs(x).max(axis=1))[1]
                scaled = np.ldexp(x, power[:, None])
                exact = (np.ldexp(scaled, -power[:, None]) == x).all(axis=1)  # else it holds numbers too small to scale
                x = np.ascontiguousarray(np.where(exact[:, None], scaled, x))
            ids = b.column("id").filter(pa.array(whole)).filter(pa.array(good))
            vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids, vec], ["id", "vec"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).mapInArrow(run, "id bigint, vec binary")


def _unit(raw: list[bytes] | np.ndarray, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f4").reshape(-1, dim).astype("f8")
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype("f4")


@dataclass
class Forest:
    """``planes[t]``: (2**fitted - 1, dim) normals and their offsets as a heap; ``deep``: further normals per tree, with offsets
    by fitted leaf; ``salts``: parts into which a leaf's points are dealt, where the sample shows one that can't be split."""

    dim: int
    fitted: int
    planes: list[tuple[np.ndarray, np.ndarray]]
    deep: list[tuple[np.ndarray, np.ndarray]]
    salts: np.ndarray

    @property
    def depth(self) -> int:
        return self.fitted + self.deep[0][0].shape[0]

    def _side(self, t: int, level: int, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Signed distance to the plane met at ``level``; ``node`` holds the path so far as a number with a leading 1."""
        if level < self.fitted:
            w, c = self.planes[t]
            return np.einsum("ij,ij->i", x, w[node - 1]) - c[node - 1]
        w, c = self.deep[t]
        leaf = (node >> (level - self.fitted)) - (1 << self.fitted)
        return x @ w[level - self.fitted] - c[leaf, level - self.fitted]

    def descend(self, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf numbers and the margins at each level."""
        node, margins = np.ones(len(x), "i8"), np.empty((len(x), self.depth), "f4")
        for level in range(self.depth):
            margins[:, level] = m = self._side(t, level, node, x)
            node = 2 * node + (m > 0)
        return node, margins

    def follow(self, t: int, level: np.ndarray, leaf: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves reached by going to the other side at each row's ``level`` of the way to ``leaf``, and the margins below it (infinite
        at that level and above)."""
        node, margins = np.ones(len(x), "i8"), np.full((len(x), self.depth), np.inf, "f4")
        for at in range(self.depth):
            below = np.nonzero(level < at)[0]
            step = (leaf >> (self.depth - at - 1)) & 1
            step = np.where(level == at, 1 - step, step)
            if len(below):
                m = self._side(t, at, node[below], x[below])
                step[below] = m > 0
                margins[below, at] = np.abs(m)
            node = 2 * node + step
        return node, margins

    def cells(self, x: np.ndarray, ids: np.ndarray, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """``(cell, which rows, own)``: the leaves of each row, own ones first, then those reached through the queue."""
        n, trees = len(x), len(self.planes)
        size = self.depth * (trees + max(0, probes - 1))
        far, leaf_of = np.full((n, size), np.inf, "f4"), np.zeros((n, size), "i8")
        tree_of, level_of = np.zeros((n, size), "i2"), np.tile(np.arange(self.depth, dtype="i2"), (n, max(1, size // max(1, self.depth))))[:, :size]
        for t in range(trees):
            leaf, m = self.descend(t, x)
            at = slice(t * self.depth, (t + 1) * self.depth)
            far[:, at], leaf_of[:, at], tree_of[:, at] = np.abs(m), leaf[:, None], t
            yield self._cell(t, leaf, self._part(t, leaf, ids)), np.arange(n), True
            if t == 0:
                yield from self._other_parts(leaf, ids)
        if not self.depth:
            return
        rows = np.arange(n)
        for k in range(probes):
            top = far.argmin(axis=1)
            distance, tree, level, leaf = far[rows, top], tree_of[rows, top], level_of[rows, top], leaf_of[rows, top]
            far[rows, top] = np.inf
            for t in range(trees):
                here = np.nonzero((tree == t) & np.isfinite(distance))[0]
                if not len(here):
                    continue
                reached, m = self.follow(t, level[here], leaf[here], x[here])
                if k + 1 < probes:
                    at = slice((trees + k) * self.depth, (trees + k + 1) * self.depth)
                    far[here, at], leaf_of[here, at], tree_of[here, at] = np.maximum(m, distance[here, None]), reached[:, None], t
                yield self._cell(t, reached, self._part(t, reached, ids[here])), here, False

    def _parts(self, t: int, leaf: np.ndarray) -> np.ndarray:
        return self.salts[t][(leaf >> (self.depth - self.fitted)) - (1 << self.fitted)]

    def _part(self, t: int, leaf: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = (ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15 + 2 * t)) >> np.uint64(40)
        return (mixed % self._parts(t, leaf).astype("u8")).astype("i8")

    def _cell(self, t: int, leaf: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (leaf * len(self.planes) + t) * PARTS + part

    def _other_parts(self, leaf: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """The first tree's parts besides a row's own."""
        parts, own = self._parts(0, leaf), self._part(0, leaf, ids)
        for step in range(1, int(parts.max(initial=1))):
            here = np.nonzero(parts > step)[0]
            yield self._cell(0, leaf[here], (own[here] + step) % parts[here]), here, False


def fit(sample: np.ndarray, total: int, trees: int, leaf: int = LEAF, seed: int = 7) -> Forest:
    """Trees over unit vectors; ``total`` is the number of points that will be put in."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    depth = max(0, int(np.ceil(np.log2(max(1, total) / leaf))))
    fitted = max(0, min(depth, int(np.log2(max(1, len(sample)) / FITTED_LEAF))))
    planes, deep, salts = [], [], np.ones((trees, 1 << fitted), "i8")
    for t in range(trees):
        w, c = np.zeros(((1 << fitted) - 1, dim), "f4"), np.zeros((1 << fitted) - 1, "f4")
        parts = [np.arange(len(sample))]
        for level in range(fitted):
            below = []
            for k, ix in enumerate(parts):
                normal = _plane(sample, ix, rng)
                at = sample[ix] @ normal
                cut = np.median(at) if len(ix) else 0.0
                if len(ix) and cut == at.max() > at.min():  # many lie on the upper side of the plane itself
                    cut = at[at < cut].max()
                w[(1 << level) - 1 + k], c[(1 << level) - 1 + k] = normal, cut
                below += [ix[at <= cut], ix[at > cut]]
            parts = below
        more = depth - fitted
        dw = rng.standard_normal((more, dim)).astype("f4")
        dw /= np.linalg.norm(dw, axis=1, keepdims=True) if more else 1
        dc = np.stack([np.median(sample[ix] @ dw.T, axis=0) if len(ix) else np.zeros(more) for ix in parts]).astype("f4") if more else np.zeros((1 << fitted, 0), "f4")
        planes.append((w, c))
        deep.append((dw, dc))
        # what the fullest leaf below a fitted one will hold: where many of its drawn points stay together, no plane splits them
        together = np.array([np.unique(sample[ix] @ dw.T > c, axis=0, return_counts=True)[1].max(initial=0) if more and len(ix) else 0 for ix, c in zip(parts, dc)])
        held = np.array([len(ix) for ix in parts])
        share = np.where(together > 2, together / np.maximum(1, held), 1.0 / (1 << more))
        expected = held / max(1, len(sample)) * total * share
        salts[t] = np.clip(np.ceil(expected / (8 * leaf)), 1, PARTS).astype("i8")
    return Forest(dim, fitted, planes, deep, salts)


def _plane(sample: np.ndarray, ix: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The direction between two drawn points, each moved to the middle of those nearer to it; a random one where they coincide."""
    if len(ix) >= 2:
        p, q = sample[rng.choice(ix, 2, replace=False)]
        some = sample[rng.choice(ix, min(len(ix), 256), replace=False)]
        for _ in range(2):
            near = some @ (p - q) > (p @ p - q @ q) / 2
            if near.all() or not near.any():
                break
            p, q = some[near].mean(axis=0), some[~near].mean(axis=0)
        if (size := np.linalg.norm(p - q)) > 1e-6:
            return (p - q) / size
    w = rng.standard_normal(sample.shape[1]).astype("f4")
    return w / np.linalg.norm(w)


def _search_leaf(dim: int, k: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        ids = np.asarray(t["id"])
        own = np.asarray(t["own"])
        raw = np.frombuffer(b"".join(t["vec"].to_pylist()), dtype="<f4").reshape(-1, dim).astype("f8")
        unit = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
        low = unit.astype("f4")
        base = np.nonzero(own)[0]
        ii, jj, cc = [], [], []
        for at in range(0, len(ids), 512):  # blocks of rows bound the memory
            near = low[at : at + 512] @ low[base].T
            near[ids[at : at + 512, None] == ids[None, base]] = -2
            floor = np.full(len(near), least - 1e-5, "f4")
            if len(base) > k + 8:  # whatever the exact order, the k best lie above the (k + 8)th less the rounding
                floor = np.maximum(floor, np.partition(near, len(base) - k - 8, axis=1)[:, len(base) - k - 8] - np.float32(1e-5))
            i, j = np.nonzero((near >= floor[:, None]) & (near > -2))
            i, j = i + at, base[j]
            cos = np.minimum(np.einsum("ij,ij->i", raw[i], raw[j]) / np.sqrt(np.einsum("ij,ij->i", raw[i], raw[i]) * np.einsum("ij,ij->i", raw[j], raw[j])), 1.0)
            keep = cos >= least
            i, j, cos = i[keep], j[keep], cos[keep]
            order = np.lexsort((ids[j], -cos, i))
            i, j, cos = i[order], j[order], cos[order]
            start = np.r_[0, np.nonzero(np.diff(i))[0] + 1] if len(i) else np.zeros(0, int)
            rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
            ii.append(ids[i[rank < k]])
            jj.append(ids[j[rank < k]])
            cc.append(cos[rank < k])
        return pa.table({"id": np.concatenate(ii), "nbr": np.concatenate(jj), "cos": np.concatenate(cc)})

    return run


def neighbours(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, least: float = -1.0, trees: int = 4, probes: int = 2) -> DataFrame:
    """``id, nbr, cos``: for each usable vector up to ``k`` other usable vectors with the largest cosine (at least ``least``), by
    ties the smaller id. Copies of one vector are neighbours of each other with cosine 1. Ids must be unique: of repeated rows
    one counts. An empty table, or one without usable vectors, gives no rows. Approximate in one way only: a neighbour that
    shares no searched leaf is missed; cosines are exact. A leaf of any size is searched whole.
    """
    spark = df.sparkSession
    log = StageLog(spark)
    valid = usable(df, id_col, vec_col, dim)
    keep = k + 1
    first = first_k(valid, ["vec"], [F.col("id")], keep)
    w_rep = F.min("id").over(Window.partitionBy("vec"))
    first = log.stage(first.withColumn("rep", w_rep).select("id", "rep", F.col("_rank").alias("rank"), F.when(F.col("_rank") == 1, F.col("vec")).alias("vec"), F.when(F.col("_rank") == keep, F.col("vec")).alias("full")), "p4-points")
    n, n_copies, n_full = first.agg(F.count("vec"), F.count_if(F.col("rank") > 1), F.count("full")).first()
    points = first.where("rank = 1").select("id", "vec")
    sample = points.where(F.shiftrightunsigned(F.xxhash64("id"), 2) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 62)))
    raw = [r[0] for r in sample.select("vec").limit(2 * SAMPLE).collect()]  # about SAMPLE points, 8 MB at 64 dimensions; never over twice that
    forest = spark.sparkContext.broadcast(fit(_unit(raw, dim) if raw else np.zeros((0, dim), "f4"), n, trees))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column("id"))
            x = _unit(b.column("vec").to_pylist(), dim)
            for cell, rows, own in forest.value.cells(x, ids, probes):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[rows]), pa.array(np.full(len(rows), own)), b.column("vec").take(at)], ["cell", "id", "own", "vec"])

    leaves = points.mapInArrow(route, "cell bigint, id bigint, own boolean, vec binary")
    found = leaves.groupBy("cell").applyInArrow(_search_leaf(dim, k, least), "id bigint, nbr bigint, cos double")
    # a point has at most k entries from each of its trees + probes leaves
    lists = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cos")).alias("neg"), "nbr"))), 1, k).alias("list"))
    flat = lists.select(F.col("id").alias("rep"), F.inline("list"))
    if not n_copies:
        return flat.select(F.col("rep").alias("id"), "nbr", (-F.col("neg")).alias("cos"))
    groups = first.where("rank > 1").groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("more"))  # at most k ids
    others = flat.join(groups.select(F.col("rep").alias("nbr"), "more"), "nbr", "left").select(
        "rep", "neg", F.explode(F.concat(F.array("nbr"), F.coalesce("more", F.array().cast("array<bigint>")))).alias("nbr"))
    alike = groups.select("rep", F.lit(-1.0).alias("neg"), F.explode(F.concat(F.array("rep"), "more")).alias("nbr"))
    best = others.unionByName(alike).groupBy("rep").agg(F.slice(F.sort_array(F.collect_set(F.struct("neg", "nbr"))), 1, keep).alias("list"))
    members = first.select("id", "rep").distinct()
    if n_full:  # copies beyond the first k + 1
        ends = first.where("full is not null").select(F.col("full").alias("vec"), "rep", F.col("id").alias("last"))
        # a direction in many rows is met by its few ends: broadcast while they are few, else only those of heavy directions
        if n_full <= 1000:
            beyond = valid.join(F.broadcast(ends), "vec")
        else:
            beyond = lookup_join(valid, ends, "vec", heavy_keys(valid, "vec", n + n_copies))
        members = members.unionByName(beyond.where("id > last").select("id", "rep"))
    mine = members.join(best, "rep").select("id", F.slice(F.filter("list", lambda x: x["nbr"] != F.col("id")), 1, k).alias("list"))
    return mine.select("id", F.inline("list")).select("id", "nbr", (-F.col("neg")).alias("cos"))


def similar_pairs(near: DataFrame) -> DataFrame:
    """``id_a, id_b``: each pair of which either has the other in its list, once, the smaller id first."""
    return near.select(F.least("id", "nbr").alias("id_a"), F.greatest("id", "nbr").alias("id_b")).distinct()
