import pytest
from pyspark.sql import functions as F

from carillon.operators import catalog as C
from carillon.operators import evaluate as E
from carillon.operators import reconcile as R
from carillon.operators import series as S
from carillon.operators import similarity as M
from carillon.operators import temporal as T
from carillon.operators import transitions as X
from carillon.operators import verify as Y


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_ranking_order(spark):
    df = spark.createDataFrame([(7, [0.0, 1.0]), (3, [1.0, 1.0]), (5, [1.0, 1.0]), (9, [1.0, 0.0]), (1, None), (2, [0.0, 0.0])], "id bigint, v array<float>")
    assert [r[0] for r in rows(M.top_k(df, [1.0, 0.0], "id", "v", 10), "rank")] == [9, 3, 5, 7]


def test_pooling(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0]), (3, [1.0, 0.0])], "g int, v array<float>")
    got = rows(M.centroids(df, ["g"], "v"), "g", "dim")
    assert [(g, d, round(v, 9)) for g, d, v in got] == [(1, 0, 0.6), (1, 1, 0.8)]


def test_paging_bounds(spark):
    for limit, offset in ((0, 0), (201, 0), (1, -1), (1, 100_001)):
        with pytest.raises(ValueError):
            C.page(spark.range(3), [F.col("id")], limit, offset)
    assert C.page(spark.range(0), [F.col("id")]).count() == 0


def test_gate_and_nulls(spark):
    df = spark.createDataFrame([("valid", "valid"), ("valid", None), (None, "valid"), ("conflict", "valid"), ("warning", "warning")], "s string, v string")
    assert df.where(C.visible(F.col("s"), F.col("v"))).count() == 2


def test_as_of_ties_and_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 11), (2, 5)], "g int, pos int")
    right = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 12, 3, "c")], "g int, ts int, seq int, line string")
    assert rows(T.as_of(left, right, ["g"], "pos", "ts", "seq", ["line"]), "g", "pos") == [(1, 5, None), (1, 10, "b"), (1, 11, "b"), (2, 5, None)]


def test_wave_buckets(spark):
    df = spark.range(1103).select(F.lit(1).alias("t"), F.col("id").alias("f"), F.when(F.col("id") == 1102, 1.0).otherwise(0.0).alias("x"))
    assert [r[1:3] for r in rows(S.wave_buckets(df, "t", "f", "x", 11025))] == [(0, 255)]
    n = spark.range(178_605).select(F.lit(1).alias("t"), F.col("id").alias("f"), F.lit(0.0).alias("x"))
    got = rows(S.wave_buckets(n, "t", "f", "x", 44_100))
    assert len(got) == 41 and {r[2:] for r in got} == {(0, 0)}


def test_silence_is_gated(spark):
    df = spark.range(1000).select(F.lit(1).alias("t"), F.col("id").alias("f"), F.lit(0.0).alias("x"))
    assert rows(S.gated_loudness(df, "t", "f", "x", 10)) == [(1, 0, -70.0)]


def test_resample_any_partitioning(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("t"), F.floor(F.col("id") / 2).alias("f"), (F.col("id") * 1.0).alias("x"))
    a, b = (rows(S.resample(df.repartition(n), "t", "f", "x", 2, 3), "t", "frame") for n in (1, 7))
    assert a == b and len(a) == 76


def test_patches_and_fill(spark):
    df = spark.createDataFrame([(0,), (10,), (18,), (26,)], "n int")
    assert [rows(df.select(S.patch_starts(F.col("n"), 18, 7, p))) for p in ("drop", "pad", "end")] == [
        [([],), ([],), ([0],), ([0, 7],)], [([],), ([0],), ([0],), ([0, 7, 14],)], [([],), ([],), ([0],), ([0, 7, 8],)]]
    v = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert [v.select(S.fill(F.col("v"), 6, p)).first()[0] for p in ("zero", "repeat", "reflect")] == [[1, 2, 3, 0, 0, 0], [1, 2, 3, 3, 3, 3], [1, 2, 3, 2, 1, 2]]


def test_transition_ladder(spark):
    loud, quiet, fast = [0.8] * 30, [0.8] * 10 + [0.0] * 20, [0.9] * 5
    fading = [0.8] * 20 + [0.1] * 10
    cases = [
        (loud, fast, 0.0, False, False, ("gapless", None)), (loud, fast, 8.0, True, False, ("gapless", None)), (None, fast, 8.0, False, False, ("fade", 8.0)), (quiet, fast, 8.0, False, False, ("gapless", None)),
        (loud, fast, 8.0, False, True, ("gapless", None)), (loud, fast, 8.0, False, False, ("hard_cut", None)), (loud, [0.001, 0.001, 0.001, 0.001, 0.001], 8.0, False, False, ("fade", 1.0)), (fading, fast, 8.0, False, False, ("fade", 1.5)),
        (fading, fast, 0.5, False, False, ("fade", 0.5)),
    ]
    df = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "k int, tail array<double>, head array<double>, f double, one boolean, same boolean")
    got = df.select("k", X.plan(F.col("tail"), F.col("head"), F.lit(100.0), F.lit(100.0), F.col("f"), F.col("one"), F.col("same"), 0.1).alias("p")).orderBy("k").collect()
    assert [(r.p.kind, r.p.seconds) for r in got] == [c[5] for c in cases]


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 2.0, 3.0), (2, 1.0, 1.0), (3, 5.0, 1.0), (3, 5.0, 2.0)], "g int, x double, y double")
    got = {g: rho for g, n, rho in rows(E.spearman(df, ["g"], "x", "y"))}
    assert got[1] == pytest.approx(0.8660254) and got[2] is None and got[3] is None
    assert rows(E.nearest_rank(spark.range(10), "id", [0, 50, 99, 100]), "p") == [(0, 0), (50, 4), (99, 8), (100, 9)]
    assert E.nearest_rank(spark.range(0), "id", [50]).count() == 0
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    want = sorted(r.v for r in hot.collect())
    assert rows(E.nearest_rank(hot, "v", [10, 30, 77]), "p") == [(p, want[(2999 * p) // 100]) for p in (10, 30, 77)]


def test_strata_sizes(spark):
    df = spark.range(7).select(F.lit(1).alias("g"), "id")
    assert [r.stratum for r in E.strata(df, ["g"], [F.col("id")], 3).orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 2]
    assert [r.id for r in E.evenly_spaced(df, ["g"], [F.col("id")], 3).orderBy("id").collect()] == [0, 2, 4]


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = R.upsert(old, new, ["k"])
    assert rows(once, "k") == [(1, "a"), (2, "c"), (3, "d")] == rows(R.upsert(once, new, ["k"]), "k")
    assert rows(R.upsert(old, new, ["k"], F.lit(False)), "k") == [(1, "a"), (2, "b"), (3, "d")]


def test_classify(spark):
    s = "path string, digest string, f string"
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z"), ("d", None, "w")], s)
    new = spark.createDataFrame([("a", "1", "x"), ("b", "9", "y"), ("e", "3", "z"), ("f", "7", "q"), ("d", None, "w")], s)
    got = dict(rows(R.classify(old, new, "path", "digest", "f")))
    assert got == {"a": "unchanged", "b": "updated", "c": "gone", "e": "moved", "f": "added", "d": "updated"}


def test_match_rows_in_order(spark):
    s = "media bigint, id bigint, pos int, digest string"
    old = spark.createDataFrame([(1, 10, 1, "a"), (1, 11, 2, "a"), (1, 12, 3, "b"), (1, 13, 4, "")], s)
    new = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 9, "a"), (1, 3, 8, "b"), (1, 4, 4, ""), (1, 5, 5, "c")], s)
    assert rows(R.match_rows(old, new, "media").select("new_id", "old_id"), "new_id") == [(1, 10), (2, 11), (3, 12), (4, None), (5, None)]


def test_arbitration(spark):
    c = spark.createDataFrame([("k", "a", "1"), ("k", "b", "1"), ("k", "c", "2"), ("m", "z", "9")], "k string, path string, fingerprint string")
    o = spark.createDataFrame([("m", "y", "9", True), ("k", "gone", "5", False)], "k string, path string, fingerprint string, present boolean")
    assert rows(R.arbitrate(c, o, "k"), "k", "path") == [("k", "a", "owner"), ("k", "b", "mirror"), ("k", "c", "conflict"), ("m", "z", "mirror")]


def test_schema_versions(spark):
    steps = [lambda d: d.withColumn("a", F.lit(1)), lambda d: d.withColumn("b", F.lit(2))]
    assert R.upgrade(spark.range(1), 1, steps).columns == ["id", "b"]
    with pytest.raises(ValueError):
        R.upgrade(spark.range(1), 3, steps)


def test_findings(spark):
    a = spark.createDataFrame([(1, "a", "x"), (2, "../b", "x"), (3, "c", "x"), (4, "d", "x"), (5, "e", None)], "ord int, path string, digest string")
    inv = spark.createDataFrame([("a", 1, "x"), ("c", 99, "x"), ("d", 1, "y"), ("e", 1, None)], "path string, size bigint, digest string")
    assert rows(Y.findings(a, inv, 50).select("ord", "finding"), "ord") == [(2, "unsafe path"), (3, "too large"), (4, "digest differs")]
    assert Y.findings(a.limit(0), inv).count() == 0


def test_nesting_keeps_childless_parents(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, t string")
    assert [(r.k, [x.t for x in r.kids]) for r in C.nest(p, c, "k", ["n"], ["t"], "kids").orderBy("k").collect()] == [(1, ["a", "b"]), (2, [])]


def test_global_rank_and_stratified_pick(spark):
    import random

    from carillon.operators.skew import global_rank

    rng = random.Random(3)
    data = [(k, rng.randrange(50), rng.choice("abc"), f"{rng.random():.9f}") for k in range(500)]
    df = spark.createDataFrame(data, "id int, score int, g string, key string").repartition(7)
    order = [F.col("score").desc(), F.col("id")]
    want = sorted(data, key=lambda r: (-r[1], r[0]))
    assert [r.id for r in global_rank(df, order).orderBy("rank").collect()] == [r[0] for r in want]
    used, picks = {}, []
    for b in range(9):
        part = want[b * 500 // 9 : (b + 1) * 500 // 9]
        best = min(part, key=lambda r: (used.get(r[2], 0), r[3]))
        used[best[2]] = used.get(best[2], 0) + 1
        picks.append((b, best[0]))
    assert [(r.bucket, r.id) for r in E.stratified_pick(df, order, "key", ["g"], 9).orderBy("bucket").collect()] == picks
    assert E.stratified_pick(df.limit(0), order, "key", ["g"], 9).count() == 0 and E.stratified_pick(df.limit(3), order, "key", ["g"], 9).count() == 3


def test_ownership_is_the_ordered_fold(spark):
    import random

    from carillon.operators.reconcile import arbitrate

    rng = random.Random(4)
    owners = [(f"k{k}", f"p{rng.randrange(20):02d}", rng.choice("abc"), rng.random() < 0.6) for k in range(12)]
    cands = sorted({(f"k{rng.randrange(14)}", f"p{rng.randrange(20):02d}"): rng.choice("abc") for _ in range(150)}.items())
    want = {}
    for key in {k for (k, _), _ in cands}:
        held = next(((p, f) for k, p, f, here in owners if k == key and here), (None, None))
        for (k, path), finger in cands:
            if k == key:
                if held[0] in (None, path):
                    held, what = (path, finger), "owner"
                else:
                    what = "mirror" if held[1] == finger else "conflict"
                want[k, path] = what
    got = arbitrate(spark.createDataFrame([(k, p, f) for (k, p), f in cands] + [(None, "x", "a")], "key string, path string, fingerprint string"), spark.createDataFrame(owners, "key string, path string, fingerprint string, present boolean"), "key")
    assert {(r.k, r.path): r.outcome for r in got.collect()} == want


def test_artists_are_filled_and_never_overwritten(spark):
    from carillon.operators.reconcile import upsert_artists

    known = spark.createDataFrame([(1, "Anna", None, None), (2, "Bernd", "B", "m2"), (3, "Clara", None, "m3"), (4, "Doris", None, None)], "id bigint, name string, sort_name string, anchor string")
    typed = spark.createDataFrame([("ANNA", "A, N", "m1"), ("Bernd", "other", "m9"), ("Klara", "C, K", "m3"), ("doris", None, None), ("New", None, "m5"), ("newer", "n", "m5"), ("NEW", "z", None), (None, "x", "m7"), ("Zoe", None, "m1")], "name string, sort_name string, anchor string")
    got = {(r.id, r.name): (r.sort_name, r.anchor) for r in upsert_artists(known, typed).collect()}
    assert got == {(1, "Anna"): ("A, N", "m1"), (2, "Bernd"): ("B", "m2"), (3, "Clara"): ("C, K", "m3"), (4, "Doris"): (None, None), (None, "NEW"): ("z", "m5")}
    assert upsert_artists(known, typed.limit(0)).count() == 4


@pytest.mark.parametrize("windowed", [0, 64 << 20])
def test_places_in_groups_with_and_without_a_window_over_a_group(spark, windowed, monkeypatch):
    from carillon.operators import evaluate
    from carillon.operators.evaluate import average_ranks, evenly_spaced, strata

    monkeypatch.setattr(evaluate, "WINDOWED", windowed)
    rows = [(g, float(v), k) for k, (g, v) in enumerate([("a", 3), ("a", 1), ("a", 1), ("b", 5), (None, 2), (None, 2), ("a", float("nan")), ("b", 4)])]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    got = {r.k: r.r for r in average_ranks(df, ["g"], "v", "r").collect()}
    assert got == {0: 3.0, 1: 1.5, 2: 1.5, 3: 2.0, 4: 1.5, 5: 1.5, 6: 4.0, 7: 1.0}
    assert {r.k: r.stratum for r in strata(df, ["g"], [F.col("k")], 2).collect()} == {0: 0, 1: 0, 2: 1, 6: 1, 3: 0, 7: 1, 4: 0, 5: 1}
    assert {r.k for r in evenly_spaced(df, ["g"], [F.col("k")], 2).collect()} == {0, 2, 3, 7, 4, 5}
    assert average_ranks(df.limit(0), ["g"], "v", "r").count() == strata(df.limit(0), ["g"], [F.col("k")], 2).count() == 0
