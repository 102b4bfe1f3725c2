"""Records of several sources combined by temperature, or to target shares, of tokens.

Each mix is planned from one number a source, its tokens. By temperature the weights are ``own ** a``, the sources' own token shares
exponentiated, and the exponent is bisected: to a wanted entropy, or to the least (the most even mix) at which no source is repeated
too often at the mix's size. Where a mix names shares, and they can be had, they hold: without a size it gets the largest at which
every share can be met within the allowed repeats; at a larger size the shares are tempered towards the sources' own,
``share ** (1 - a) * own ** a``, with the exponent bisected to the repetition limit. The weights are realised as block
permutations: a source's records are used in blocks, each a permutation of all of them by a seeded hash, whole blocks first and of
the last block as much as the budget holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carillon.session import StageLog

#: Records in one part of the hash range, about, and parts at most: running sums are taken over parts first, so that no task
#: orders a whole source, and only the part in which the budget ends is walked record by record.
PART, MOST_PARTS = 4096, 1 << 16


def tidy(c: Column) -> Column:
    """A source's name in one writing: lower case, without outer blanks, words joined by ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def entropy(w: list[float]) -> float:
    return -sum(x * math.log2(x) for x in w if x > 0)


def tempered(own: list[float], a: float, towards: list[float] | None = None) -> list[float]:
    """``own ** a``, or on the way from ``towards`` (a = 0) to ``own`` (a = 1), normalised. A share of zero stays zero."""
    raw = [(o**a if towards is None else t ** (1 - a) * o**a) if o > 0 and (towards is None or t > 0) else 0.0 for o, t in zip(own, towards or own)]
    total = sum(raw)
    return [x / total for x in raw] if total else raw


def bisect(low: float, high: float, holds, steps: int = 60) -> float:
    """The least exponent between ``low`` and ``high`` at which ``holds``, which is true at ``high``."""
    if holds(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def exponent_for_entropy(own: list[float], wanted: float) -> float:
    """``a`` with ``entropy(own ** a)`` nearest to ``wanted``: 0 is even, 1 the sources' own shares, more is sharper."""
    return bisect(0.0, 64.0, lambda a: entropy(tempered(own, a)) <= wanted)


@dataclass(frozen=True)
class Part:
    mix_name: str
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    exponent: float
    weight: float
    budget: int
    records: int = 0


BY = ("shares", "entropy", "repeats")


def plan(mix_name: str, parts: list[tuple[str, float | None, int, int]], total: float | None = None, wanted_entropy: float | None = None, by: str = "shares") -> list[Part]:
    """Budgets for ``(source, target_share, max_repeats, tokens)``. Sources without tokens get nothing; shares need not sum to 1.

    ``by`` shares: as the shares say. By entropy: ``own ** a`` with the entropy of the target shares, or ``wanted_entropy``; without
    a size the largest that the repeats allow. By repeats: ``own ** a`` with the least exponent from 0 (even) to 1 (own shares) at
    which no source is repeated too often; without a size as many tokens as the sources have.
    """
    if by not in BY:
        raise ValueError(f"a mix is made by one of {BY}")
    has = [p for p in parts if p[3] > 0 and p[2] > 0 and (p[1] is None or p[1] > 0)]
    if not has:
        return [Part(mix_name, s, t or 0.0, r, n, 0.0, 0.0, 0) for s, t, r, n in parts]
    own = tempered([p[3] for p in has], 1.0)
    most = [p[2] * p[3] for p in has]
    if by == "repeats":
        size = min(float(sum(p[3] for p in has)) if total is None else total, min(m / w for m, w in zip(most, own)))
        a = bisect(0.0, 1.0, lambda a: all(size * w <= m * (1 + 1e-9) for w, m in zip(tempered(own, a), most)))
        weights = tempered(own, a)
    elif by == "shares" and all(p[1] is not None for p in has):
        target = [p[1] for p in has]
        target = [t / sum(target) for t in target]
        size = min(m / t for m, t in zip(most, target)) if total is None else min(total, sum(most))
        size = min(size, max(min(m / w for m, w in zip(most, tempered(own, a, target))) for a in (0.0, 1.0)))  # beyond, no exponent will do
        fits = lambda a: all(size * w <= m * (1 + 1e-9) for w, m in zip(tempered(own, a, target), most))
        a = 0.0 if fits(0.0) else bisect(0.0, 1.0, fits)
        weights = tempered(own, a, target)
    else:
        if wanted_entropy is None:
            named = [p[1] for p in has]
            wanted_entropy = entropy(own if None in named else [x / sum(named) for x in named])
        a = exponent_for_entropy(own, wanted_entropy)
        weights = tempered(own, a)
        size = min(m / w for m, w in zip(most, weights)) if total is None else total
    budgets = {p[0]: (w, min(int(size * w + 1e-6), m)) for p, w, m in zip(has, weights, most)}
    return [Part(mix_name, s, t or 0.0, r, n, a, *budgets.get(s, (0.0, 0))) for s, t, r, n in parts]


def plans(sized: DataFrame, targets: DataFrame, total: float | None = None, by: str = "shares") -> list[Part]:
    """All mixes' parts. The targets are a table of parameters (checked: at most 10,000 rows); of the records one sum for each
    source they name comes to the driver."""
    rows = targets.select("mix_name", tidy(F.col("source")).alias("source"), "target_share", "max_repeats").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("targets is a table of parameters; it has over 10,000 rows")
    names = sorted({r[1] for r in rows if r[1] is not None})
    found = sized.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect() if names else []
    sums, counts = {r[0]: int(r[1]) for r in found}, {r[0]: int(r[2]) for r in found}
    mixes: dict[str, list] = {}
    for m, s, t, r in rows:
        if m is not None and s is not None:
            mixes.setdefault(m, []).append((s, t, r or 0, sums.get(s, 0)))
    return [replace(p, records=counts.get(p.source, 0)) for m, parts in sorted(mixes.items()) for p in plan(m, parts, total, by=by)]


def _table(spark, parts: list[Part]) -> DataFrame:
    rows = [(p.mix_name, p.source, p.target_share, p.max_repeats, p.tokens, p.exponent, p.weight, p.budget // p.tokens if p.tokens else 0, p.budget % p.tokens if p.tokens else 0, max(1, min(MOST_PARTS, p.records // PART))) for p in parts]
    return spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int, source_tokens bigint, exponent double, weight double, whole int, rest bigint, parts int")


def _fill(t: pa.Table) -> pa.Table:
    """Of the part in which a budget ends, in the block's order, each record that still fits."""
    t = t.sort_by([("at", "ascending"), ("doc_id", "ascending"), ("n_tokens", "ascending")])
    room, keep = t["room"][0].as_py(), []
    for n in t["n_tokens"].to_pylist():
        keep.append(n <= room)
        room -= n if keep[-1] else 0
    return t.filter(pa.array(keep, pa.bool_())).select(["mix_name", "source", "doc_id", "n_tokens", "block"])


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, by: str = "shares") -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, block``: one row per use of a record, ``block`` from 1 to at most ``max_repeats``.

    ``sized``: ``doc_id, source, n_tokens`` with sources as ``tidy`` writes them. Records without tokens or with a source that no
    mix names are in none; a null source is no source; repeated rows are records of their own; an empty side gives no rows.
    """
    spark = sized.sparkSession
    log = StageLog(spark)
    table = F.broadcast(_table(spark, plans(sized, targets, total, by)).select("mix_name", "source", "whole", "rest", "parts"))  # at most 10,000 rows
    records = sized.where("n_tokens > 0").select("doc_id", "source", "n_tokens").join(table, "source")
    whole = records.where("whole > 0").select("mix_name", "source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), "whole")).alias("block"))
    # the last block: running sums first over parts of the hash range, then inside the part in which the budget ends
    last = records.where("rest > 0").withColumn("block", F.col("whole") + 1)
    last = last.withColumn("at", F.xxhash64(F.lit(seed), "mix_name", "source", "block", "doc_id")).withColumn("part", (F.shiftrightunsigned("at", 32) * F.col("parts")).bitwiseAND(F.lit((1 << 62) - 1)))
    last = last.withColumn("part", F.shiftright("part", 32).cast("int"))
    sums = last.groupBy("mix_name", "source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.partitionBy("mix_name", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = log.stage(sums.withColumn("before", F.coalesce(before, F.lit(0))), "p7-sums")  # at most MOST_PARTS rows a source
    placed = last.join(sums, ["mix_name", "source", "part"])
    full = placed.where("before + part_tokens <= rest")
    edge = placed.where("before < rest and before + part_tokens > rest")
    cut = edge.select("mix_name", "source", "doc_id", "n_tokens", "block", "at", (F.col("rest") - F.col("before")).alias("room")).groupBy("mix_name", "source").applyInArrow(_fill, "mix_name string, source string, doc_id bigint, n_tokens int, block int")
    cols = ["mix_name", "source", "doc_id", "n_tokens", "block"]
    return whole.select(cols).unionByName(full.select(cols)).unionByName(cut.select(cols))


def shares(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, by: str = "shares") -> DataFrame:
    """Per mix and source what was wanted and what was got: shares of tokens, records used, the most uses of one record."""
    spark = sized.sparkSession
    parts = _table(spark, plans(sized, targets, total, by))
    used = mix(sized, targets, total, seed, by).groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("got_tokens"), F.countDistinct("doc_id").alias("records"), F.max("block").alias("most_uses"))
    joined = parts.join(used, ["mix_name", "source"], "left").withColumn("got_tokens", F.coalesce("got_tokens", F.lit(0)))
    every = F.sum("got_tokens").over(Window.partitionBy("mix_name"))
    return joined.select(
        "mix_name", "source", "target_share", F.round("weight", 6).alias("planned_share"), F.round("exponent", 6).alias("exponent"), F.round(F.try_divide(F.col("got_tokens"), every), 6).alias("actual_share"),
        "got_tokens", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
