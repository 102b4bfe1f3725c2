import pytest

from carillon.llm.mixing import entropy, exponent_for_entropy, mix, plan, shares, tempered, tidy
from pyspark.sql import functions as F


def test_exponents():
    own = [0.7, 0.2, 0.1]
    assert tempered(own, 0) == pytest.approx([1 / 3] * 3) and tempered(own, 1) == pytest.approx(own)
    a = exponent_for_entropy(own, 1.4)
    assert 0 < a < 1 and entropy(tempered(own, a)) == pytest.approx(1.4, abs=1e-9)


def test_plans():
    exact = plan("m", [("a", 0.5, 2, 100), ("b", 0.5, 4, 30), ("c", None and 0, 1, 0)][:2])
    assert [(p.weight, p.budget) for p in exact] == [(0.5, 120), (0.5, 120)]
    big = plan("m", [("a", 0.5, 2, 100), ("b", 0.5, 2, 30)], total=200)
    assert 0 < big[0].exponent < 1 and sum(p.weight for p in big) == pytest.approx(1) and big[1].budget == 60 and big[0].budget == pytest.approx(140, abs=1)
    assert all(p.budget <= p.max_repeats * p.tokens for p in plan("m", [("a", 0.9, 1, 10), ("b", 0.1, 1, 10)], total=1000))
    assert [p.budget for p in plan("m", [("a", 1.0, 0, 10), ("b", 0.0, 5, 10)])] == [0, 0]
    free = plan("m", [("a", None, 5, 900), ("b", None, 5, 100)], total=500, wanted_entropy=1.0)
    assert [p.weight for p in free] == pytest.approx([0.5, 0.5], abs=1e-6)


def test_plans_by_temperature():
    parts = [("a", 0.6, 2, 900), ("b", 0.3, 3, 90), ("c", 0.1, 4, 10)]
    even = plan("m", parts, by="repeats")
    assert 0 < even[0].exponent < 1 and all(p.budget <= p.max_repeats * p.tokens for p in even)
    assert even[2].budget == 40 and even[1].budget < 270  # the least exponent: the smallest source is at its limit
    assert sum(p.budget for p in even) == pytest.approx(1000, abs=3)
    flat = plan("m", [("a", 0.5, 100, 900), ("b", 0.5, 100, 90)], by="repeats")
    assert flat[0].exponent == 0 and flat[0].weight == pytest.approx(0.5)
    same = plan("m", parts, by="entropy")
    assert entropy([p.weight for p in same]) == pytest.approx(entropy([0.6, 0.3, 0.1]), abs=1e-6) and 0 < same[0].exponent < 1
    assert [p.weight / q.weight for p, q in zip(same, same[1:])] == pytest.approx([10 ** same[0].exponent, 9 ** same[0].exponent])
    with pytest.raises(ValueError):
        plan("m", parts, by="luck")


def _data(spark):
    docs = [(k, "big", 10 + k % 7) for k in range(3000)] + [(10_000 + k, "small", 5) for k in range(40)] + [(20_000, None, 9), (20_001, "other", 9), (20_002, "big", 0)]
    targets = [("m", "Big ", 0.8, 2), ("m", "small", 0.2, 3), ("n", "SMALL", 1.0, 1), ("o", "absent", 1.0, 2)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens int"), spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, targets = _data(spark)
    got = {(r.mix_name, r.source): r for r in shares(docs, targets).collect()}
    assert got["m", "small"].actual_share == pytest.approx(0.2, abs=0.01) and got["m", "small"].most_uses == 3 and got["m", "small"].got_tokens == 600
    assert got["n", "small"].actual_share == 1.0 and got["n", "small"].records == 40 and got["o", "absent"].got_tokens == 0
    uses = mix(docs, targets).groupBy("mix_name", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("b"), F.max("block").alias("top"))
    assert uses.where("n <> b or top > 3 or (mix_name = 'n' and n > 1)").count() == 0


def test_the_same_at_any_partitioning_and_empty(spark):
    docs, targets = _data(spark)
    a, b = mix(docs.repartition(1), targets, total=20_000.0), mix(docs.repartition(5), targets, total=20_000.0)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert mix(docs.limit(0), targets).count() == mix(docs, targets.limit(0)).count() == 0


def test_large_source_in_parts(spark, monkeypatch):
    import carillon.llm.mixing as m

    monkeypatch.setattr(m, "PART", 100)
    docs, targets = _data(spark)
    got = {(r.mix_name, r.source): r for r in shares(docs, targets, total=20_000.0).collect()}
    assert got["m", "big"].got_tokens == pytest.approx(0.97 * 20_000, rel=0.05)
    assert mix(docs, targets, total=20_000.0).groupBy("mix_name", "doc_id", "block").count().where("count > 1").count() == 0


def test_tidy(spark):
    got = [r[0] for r in spark.createDataFrame([(" Liner-Notes ",), ("scan_log",), (None,)], "s string").select(tidy(F.col("s"))).collect()]
    assert got == ["liner_notes", "scan_log", None]


def test_clashing_columns(spark):
    docs, targets = _data(spark)
    more = docs.select("*", F.lit("x").alias("whole"), F.lit(1).alias("rest"), F.lit(2).alias("block"), F.lit(3).alias("part"), F.lit(4).alias("at"))
    assert mix(more, targets).exceptAll(mix(docs, targets)).count() == 0
