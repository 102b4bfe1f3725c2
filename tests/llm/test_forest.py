import random

import numpy as np
from pyspark.sql import functions as F

from carillon.llm.forest import fit, neighbours, similar_pairs


def _exact(vectors, k, least):
    ok = {i: np.asarray(v, "f4").astype("f8") for i, v in vectors if v is not None and len(v) == 8 and np.isfinite(np.asarray(v, "f4")).all() and np.any(np.asarray(v, "f4"))}
    ids = sorted(ok)
    x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    c = np.minimum(x @ x.T, 1.0)
    out = set()
    for a, i in enumerate(ids):
        near = sorted((-round(c[a, b], 12), j) for b, j in enumerate(ids) if b != a and c[a, b] >= least)[:k]
        out |= {(min(i, j), max(i, j)) for _, j in near}
    return out


def _rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, 8))
    rows = [(k, (centres[k % len(centres)] + 0.2 * rng.standard_normal(8)).astype("f4").tolist()) for k in range(n)]
    rows += [(1000 + k, rows[k][1]) for k in range(30)] + [(2000 + k, rows[5][1]) for k in range(9)]
    return rows + [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [float("nan")] * 8), (3004, [1.0] * 7), (3005, [float("inf")] + [0.0] * 7)]


def test_against_brute_force(spark):
    rows = _rows()
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = {tuple(r) for r in similar_pairs(neighbours(df, "id", "v", 8, k=5, least=0.87)).collect()}
    want = _exact(rows, 5, 0.87)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_copies_keep_the_smallest_ids(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(20)], "id bigint, v array<float>")
    got = {}
    for r in neighbours(df, "id", "v", 2, k=3, least=0.5).collect():
        got.setdefault(r.id, []).append(r.nbr)
    assert {k: sorted(v) for k, v in got.items()} == {k: [x for x in range(5) if x != k][:3] for k in range(20)}


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.1]), (3, [1.0, 2.1])], "id bigint, v array<float>")
    got = sorted((r.id, r.nbr) for r in neighbours(df, "id", "v", 2, k=2, least=0.5).collect())
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x", 2), (2, [1.0, 0.1], "y", 3)], "cell bigint, vec array<float>, own string, rank int")
    assert [(r.id, r.nbr) for r in neighbours(df, "cell", "vec", 2, k=1).orderBy("id").collect()] == [(1, 2), (2, 1)]
    assert neighbours(df.limit(0), "cell", "vec", 2).count() == 0
    assert neighbours(df.select("cell", F.lit(None).cast("array<float>").alias("vec")), "cell", "vec", 2).count() == 0


def test_recall_of_deep_trees_beyond_the_fitted_depth():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20_000, 16)).astype("f4")
    near = x + 0.05 * rng.standard_normal(x.shape).astype("f4")
    x, near = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, near))
    forest = fit(x[:512], 20_000, 4, leaf=100)
    assert forest.depth > forest.fitted
    ids = np.arange(len(x))
    own = [set() for _ in ids]
    for cell, rows, mine in forest.cells(x, ids, 0):
        for c, r in zip(cell, rows):
            own[r].add(c)
    hit = np.zeros(len(x), bool)
    sizes = np.unique(np.concatenate([c for c, _, _ in forest.cells(x, ids, 0)]), return_counts=True)[1]
    for cell, rows, mine in forest.cells(near, ids, 4):
        for c, r in zip(cell, rows):
            hit[r] |= c in own[r]
    assert hit.mean() > 0.95 and sizes.max() < 1500


def test_a_direction_that_cannot_be_split_is_dealt_out():
    x = np.tile(np.array([[1.0, 0, 0, 0]], "f4"), (4096, 1))
    forest = fit(x, 100_000, 2, leaf=100)
    cells = np.concatenate([c for c, _, _ in forest.cells(x, np.arange(4096), 0)])
    assert len(np.unique(cells)) > 8


def test_points_that_cannot_be_split_all_meet_in_the_first_tree():
    x = np.tile(np.array([[1.0, 0, 0, 0]], "f4"), (3000, 1))
    forest = fit(x, 3000, 2, leaf=20)
    ids = np.arange(len(x))
    own, asked = {}, [set() for _ in ids]
    for cell, rows, mine in forest.cells(x, ids, 0):
        for c, r in zip(cell, rows):
            asked[r].add(c)
            if mine:
                own.setdefault(c, set()).add(r)
    assert max(map(len, own.values())) < 500 and all(set().union(*(own[c] for c in cells)) == set(range(3000)) for cells in (asked[0], asked[17], asked[2999]))


def test_probes_pop_the_nearest_branches_of_all_trees():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 8)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = fit(x, 4000, 3, leaf=60)
    ids = np.arange(len(x))
    got = [[] for _ in ids]
    for cell, rows, mine in forest.cells(x, ids, 3):
        if not mine:
            for c, r in zip(cell, rows):
                got[r].append(int(c))
    for r in range(0, 4000, 400):  # the same search, point by point, with a queue
        heap = []
        for t in range(3):
            leaf, m = forest.descend(t, x[r : r + 1])
            heap += [(float(abs(m[0, k])), t, k, int(leaf[0])) for k in range(forest.depth)]
        want = []
        for _ in range(3):
            heap.sort()
            far, t, level, leaf = heap.pop(0)
            reached, m = forest.follow(t, np.array([level]), np.array([leaf]), x[r : r + 1])
            heap += [(max(far, float(m[0, k])), t, k, int(reached[0])) for k in range(level + 1, forest.depth)]
            want.append((int(reached[0]) * 3 + t) * (1 << 14))
        assert sorted(got[r]) == sorted(want)


def test_copies_of_another_length_are_copies(spark):
    base = [0.3, -1.7, 2.5]
    df = spark.createDataFrame([(k, [x * 2.0 ** (k % 5 - 2) for x in base]) for k in range(12)] + [(20, [1e-38, 1e-45, 0.0])], "id bigint, v array<float>")
    got = {}
    for r in neighbours(df, "id", "v", 3, k=3, least=0.9).collect():
        got.setdefault(r.id, []).append(r.nbr)
    assert {k: sorted(v) for k, v in got.items()} == {k: [x for x in range(5) if x != k][:3] for k in range(12)}
