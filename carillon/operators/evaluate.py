"""Quality of a retrieval: overlap, displacement, rank correlation, reversals, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carillon.session import estimated_bytes


def ranked_lists(ranked: DataFrame, query: str, item: str, rank: str, k: int, name: str = "list") -> DataFrame:
    """``query, list``: each query's first ``k`` items in order."""
    top = ranked.where(F.col(rank) <= k).groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i")))).alias("_l"))
    return top.select(query, F.transform("_l", lambda x: x["i"]).alias(name))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two lists; 1 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.nullif(every, F.lit(0))))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the longer list's."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.nullif(most, F.lit(0))))


def displacement(a: DataFrame, b: DataFrame, query: str, item: str, rank: str) -> DataFrame:
    """``query, item, moved``: by how many places an item in both rankings moved."""
    return a.select(query, item, F.col(rank).alias("_a")).join(b.select(query, item, F.col(rank).alias("_b")), [query, item]).select(query, item, F.abs(F.col("_a") - F.col("_b")).alias("moved"))


def nearest_rank(df: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """``p, value``: percentiles as values that occur: place ``(n - 1) * p / 100`` in whole numbers, 100 the last. Rows are counted
    per value, the counts range-sorted and written, one sum a part comes to the driver, and only the parts in which a place lies
    are walked, each in a task of its own. Null values don't count; an empty table gives no rows."""
    from carillon.session import stage

    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    parted = stage(counts.orderBy(value).withColumn("_part", F.spark_partition_id()), "counted")
    sums = sorted((r[0], r[1]) for r in parted.groupBy("_part").agg(F.sum("_c")).collect())  # one row a part
    total, before, want = sum(n for _, n in sums), 0, []
    for part, n in sums:
        for p in percents:
            at = total - 1 if p == 100 else (total - 1) * p // 100
            if before <= at < before + n:
                want.append((part, p, at - before))
        before += n
    wanted = F.broadcast(spark.createDataFrame(want, "_part int, p int, _at bigint"))  # one row a percentile
    run = F.sum("_c").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    hit = parted.join(F.broadcast(wanted.select("_part").distinct()), "_part", "left_semi").withColumn("_hi", run)
    return hit.join(wanted, "_part").where((F.col("_at") >= F.col("_hi") - F.col("_c")) & (F.col("_at") < F.col("_hi"))).select("p", F.col(value).alias("value"))


def _within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Each row's place from 1 in the order of its group, and the group's size in ``_n``: places in one order of all rows, less the
    group's first. No task sorts a whole group, unless all rows together are few (``WINDOWED``)."""
    from carillon.operators.skew import global_rank

    if estimated_bytes(df) <= WINDOWED:
        w = Window.partitionBy(*by)
        return df.withColumn(name, F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))

    ranked = global_rank(df, [*(F.col(c) for c in by), *order], "_place")
    groups = ranked.groupBy(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by))).agg(F.min("_place").alias("_low"), F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    few = groups.limit(FEW + 1).count() <= FEW  # groups are broadcast while they are few; beyond, a frequent one is split at run time
    met = ranked.join(F.broadcast(groups) if few else groups, same)
    return met.withColumn(name, F.col("_place") - F.col("_low") + 1).drop("_place", "_low", *(f"_g{k}" for k in range(len(by))))


#: Groups that are broadcast, at most.
FEW = 10_000
#: Bytes up to which a whole table may be ranked by windows, each group in one task; the result is the same.
WINDOWED = 64 << 20


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties sharing the mean of their places. NaN sorts last. A value's ties are counted first, so that only one row a
    value is ranked; a value that many rows share is joined apart. Few rows (``WINDOWED``) are ranked by windows."""
    if estimated_bytes(df) <= WINDOWED:
        w = Window.partitionBy(*by).orderBy(value)
        return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0)
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = _sums_before(ties, by, value)
    same = F.lit(True)
    for k, c in enumerate([*by, value]):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    keys = parts.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate([*by, value])), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(keys, same).drop(*(f"_g{k}" for k in range(len(by) + 1)))


def _sums_before(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """``_before``: the sum of ``_c`` over the smaller values of a group. Sums are taken by parts of one order of all rows, and one sum a
    part comes to the driver."""
    from carillon.session import stage

    spark = counts.sparkSession
    parted = stage(counts.orderBy(*by, value).withColumn("_part", F.spark_partition_id()), "counted")
    sums = sorted((r[0], r[1]) for r in parted.groupBy("_part").agg(F.sum("_c")).collect())  # one row a part
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    table = F.broadcast(spark.createDataFrame(starts, "_part int, _start bigint"))
    run = F.sum("_c").over(Window.partitionBy("_part").orderBy(*by, value).rowsBetween(Window.unboundedPreceding, -1))
    placed = parted.join(table, "_part").withColumn("_all", F.coalesce(run, F.lit(0)) + F.col("_start"))
    groups = placed.groupBy(*(F.col(c).alias(f"_h{k}") for k, c in enumerate(by))).agg(F.min("_all").alias("_low"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_h{k}"))
    few = groups.limit(FEW + 1).count() <= FEW
    return placed.join(F.broadcast(groups) if few else groups, same).withColumn("_before", F.col("_all") - F.col("_low"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, n, rho``: Pearson's correlation of average ranks; null below two rows or without spread."""
    r = average_ranks(average_ranks(df, by, x, "_x"), by, y, "_y")
    var = (F.count(F.lit(1)) > 1) & (F.var_pop("_x") > 0) & (F.var_pop("_y") > 0)
    num = F.avg(F.col("_x") * F.col("_y")) - F.avg("_x") * F.avg("_y")
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(var, F.try_divide(num, F.stddev_pop("_x") * F.stddev_pop("_y"))).alias("rho"))


def zscores(df: DataFrame, by: list[str], value: str, name: str = "z") -> DataFrame:
    """Distance from the mean in population standard deviations; 0 without spread. Moments are aggregated, then joined."""
    m = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(m, by).withColumn(name, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).otherwise(F.lit(0.0))).drop("_m", "_s")


def finite_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, least and largest of the finite values."""
    x = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.count(x).alias("n"))


def reversals(a: DataFrame, b: DataFrame, query: str, item: str, rank: str) -> DataFrame:
    """``x, y``: pairs of items that stand in one order in ``a`` and in the other in ``b`` for some query, each pair once. The lists
    are top-k lists, so a query gives at most k(k-1)/2 pairs."""
    both = a.select(query, F.col(item).alias("i"), F.col(rank).alias("ra")).join(b.select(query, F.col(item).alias("i"), F.col(rank).alias("rb")), [query, "i"])
    other = both.select(query, F.col("i").alias("j"), F.col("ra").alias("sa"), F.col("rb").alias("sb"))
    return both.join(other, query).where("i < j and (ra - sa) * (rb - sb) < 0").select(F.col("i").alias("x"), F.col("j").alias("y")).distinct()


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that doesn't overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def verdict(states: DataFrame, state: str) -> DataFrame:
    """``verdict`` over gates: fail if any failed, else not-evaluated if any wasn't, else pass."""
    s = F.col(state)
    return states.agg(F.when(F.count_if(s == "fail") > 0, F.lit("fail")).when((F.count_if(s == "not-evaluated") > 0) | (F.count(F.lit(1)) == 0), F.lit("not-evaluated")).otherwise(F.lit("pass")).alias("verdict"))


def margin(ranked: DataFrame, query: str, score: str, rank: str, k: int) -> DataFrame:
    """``query, margin``: by how much the k-th score exceeds the next; null if there is none."""
    at = lambda n: F.max(F.when(F.col(rank) == n, F.col(score)))
    return ranked.where(F.col(rank).isin(k, k + 1)).groupBy(query).agg((at(k) - at(k + 1)).alias("margin"))


def strata(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "stratum") -> DataFrame:
    """Each row's contiguous part of ``k`` nearly equal ones in the order of its group."""
    r = _within(df, by, order, "_r")
    return r.withColumn(name, F.floor((F.col("_r") * k - 1) / F.col("_n")).cast("bigint")).drop("_r", "_n")


def evenly_spaced(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """Of each group the rows at ``i * n / limit``; all of a smaller group."""
    ranked = _within(df, by, order, "_r").withColumn("_r", F.col("_r") - 1)
    # r is picked if some i has floor(i*n/limit) = r, that is if ceil(r*limit/n) lies below (r+1)*limit/n and below limit
    i = F.ceil(F.col("_r") * limit / F.col("_n"))
    return ranked.where((F.col("_n") <= limit) | ((i < limit) & (F.floor(i * F.col("_n") / limit) == F.col("_r")))).drop("_r", "_n")


# The places at which two rankings must agree, the place for albums, and the ceilings of the gates.
GATE_PLACES, ALBUM_PLACE = (1, 5, 10, 12, 20), 12
COSINE_CEILING = NORM_CEILING = 2.0**-10
SUBNORMAL_CEILING = 2.0**-24


def gates(measured: DataFrame) -> DataFrame:
    """``gate, state`` of seven gates for each row of measurements, beside its other columns: ``cosine_change, stored_off, seeds,
    top_changed, tracks, track_lists_changed, albums, album_lists_changed`` (null if albums can't be told), ``vectors, off, subnormal,
    rejections``. States: pass, fail, not-evaluated where there are too few to tell. With rejections there is no stored world, so
    the first four gates aren't evaluated."""
    c, open_ = F.col, F.lit("not-evaluated")
    by = lambda ok: F.when(ok, F.lit("pass")).otherwise(F.lit("fail"))
    stored = lambda x: F.when(c("rejections") > 0, open_).otherwise(x)
    few = (c("tracks") < max(GATE_PLACES) + 1) | c("albums").isNull() | (c("albums") < ALBUM_PLACE + 1)
    states = {
        "B-A1": stored(by(c("cosine_change") <= COSINE_CEILING)), "B-A2": stored(by(c("stored_off") <= NORM_CEILING)), "B-B1": stored(F.when(c("seeds") == 0, open_).otherwise(by(c("top_changed") == 0))),
        "B-B2": stored(F.when(few, open_).otherwise(by((c("track_lists_changed") == 0) & (c("album_lists_changed") == 0)))),
        "B-C1": F.when(c("vectors") == 0, open_).otherwise(by(c("off") <= NORM_CEILING)), "B-C2": F.when(c("vectors") == 0, open_).otherwise(by(c("subnormal") <= SUBNORMAL_CEILING)), "B-C3": by(c("rejections") == 0),
    }
    rest = [x for x in measured.columns if x not in ("cosine_change", "stored_off", "seeds", "top_changed", "tracks", "track_lists_changed", "albums", "album_lists_changed", "vectors", "off", "subnormal", "rejections")]
    return measured.select(*rest, F.inline(F.array(*(F.struct(F.lit(k).alias("gate"), v.alias("state")) for k, v in states.items()))))


def overlap_summary(lists: DataFrame, a: str, b: str, places: tuple[int, ...]) -> DataFrame:
    """``k, mean_jaccard, changed``: over all queries at each place the mean overlap of two lists, and how many differ as sets."""
    at = F.explode(F.array(*(F.lit(k) for k in places))).alias("k")
    j = lists.select(a, b, at).select("k", jaccard(F.slice(a, F.lit(1), F.col("k")), F.slice(b, F.lit(1), F.col("k"))).alias("j"))
    return j.groupBy("k").agg(F.avg("j").alias("mean_jaccard"), F.count_if(F.col("j") < 1).alias("changed"))


def by_hash(df: DataFrame, key: Column, group: str, id_col: str, n_groups: int) -> DataFrame:
    """For the first ``n_groups`` groups in the order of their hash, the member of the lowest hash."""
    h = df.withColumn("_h", F.sha2(key, 256)).withColumn("_g", F.sha2(F.col(group).cast("string"), 256))
    best = h.groupBy(group, "_g").agg(F.min_by(id_col, F.struct("_h", F.col(id_col))).alias(id_col))
    return best.orderBy("_g", group).limit(n_groups).select(group, id_col)


def queries_by_hash(df: DataFrame, key: Column, group: str, id_col: str, n: int) -> DataFrame:
    """``place, id``: ``n`` rows drawn without chance: the member of the lowest hash of each of the first groups by their hash, and where
    there are fewer groups the remaining rows of the lowest hashes; numbered from 1 by hash. Both picks are bounded sorts."""
    first = by_hash(df, key, group, id_col, n).select(F.col(id_col).alias("_i"))
    hashed = df.select(F.col(id_col).alias("id"), F.sha2(key, 256).alias("_h"))
    drawn = F.broadcast(first)  # n rows
    rest = hashed.join(drawn, F.col("id") == F.col("_i"), "left_anti").orderBy("_h", "id").limit(n).withColumn("_late", F.lit(1))
    both = hashed.join(drawn, F.col("id") == F.col("_i"), "left_semi").withColumn("_late", F.lit(0)).unionByName(rest)
    chosen = both.orderBy("_late", "_h", "id").limit(n)
    return chosen.select(F.row_number().over(Window.orderBy("_h", "id")).cast("bigint").alias("place"), "id")  # n rows


def stratified_pick(pool: DataFrame, order: list[Column], key: str, spread_by: list[str], buckets: int) -> DataFrame:
    """``bucket`` and the columns of ``pool``: one row from each of ``buckets`` contiguous parts of the order. In each the row whose
    values in ``spread_by`` were used least so far is taken, earlier columns first, then the smallest ``key``. What is used feeds
    later choices, so buckets are settled in turn, each by one aggregation over its own rows; only the chosen rows, one a bucket,
    come to the driver. Null values count as a value of their own."""
    from carillon.operators.skew import global_rank
    from carillon.session import stage

    spark = pool.sparkSession
    if not 1 <= buckets <= 1000:
        raise ValueError("buckets must be from 1 to 1000")
    ranked = global_rank(pool, order, "_rank")
    n = ranked.count()
    many = max(1, min(buckets, n))
    # one folder a bucket, so that a bucket's turn reads its own rows alone
    bucket = F.floor(((F.col("_rank") - 1) * many + (many - 1)) / F.lit(max(1, n))).cast("int")
    ranked = stage(ranked.withColumn("_bucket", F.least(bucket, F.lit(many - 1))), "buckets", "_bucket")
    many = min(many, n)
    used: dict[str, dict] = {c: {} for c in spread_by}
    out = []
    for b in range(many):
        low, high = b * n // many, (b + 1) * n // many

        def uses(c: str) -> Column:
            x = F.lit(0)
            for v, k in used[c].items():
                x = F.when(F.col(c).eqNullSafe(F.lit(v)), F.lit(k)).otherwise(x)
            return x

        part = ranked.where((F.col("_bucket").isin(b - 1, b, b + 1)) & (F.col("_rank") > low) & (F.col("_rank") <= high)).drop("_rank", "_bucket")
        row = part.agg(F.min_by(F.struct(*part.columns), F.struct(*(uses(c).alias(f"u{i}") for i, c in enumerate(spread_by)), F.col(key).alias("k"))).alias("r")).first()[0]
        for c in spread_by:
            used[c][row[c]] = used[c].get(row[c], 0) + 1
        out.append((b, *row))
    return spark.createDataFrame(out, T.StructType([T.StructField("bucket", T.IntegerType()), *pool.schema.fields]))
