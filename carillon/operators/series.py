"""Buckets, gates, slices and resampling of sample streams given as ``(series, frame, value)`` with frames from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carillon.functions.audio import quantize_amplitude


def wave_buckets(df: DataFrame, series: str, frame: str, value: str, rate: int, per_second: int = 10) -> DataFrame:
    """``series, bucket, peak, rms``: quantised peak and root mean square of every tenth of a second; the last, partial bucket
    counts. Frame ``f`` falls into bucket ``f * 10 div rate``. One shuffle, sums combined before it."""
    if rate < per_second:
        raise ValueError("the rate must be at least the number of buckets a second")
    b = F.floor(F.col(frame) * per_second / rate).cast("bigint")
    x = F.col(value).cast("double")
    per = df.groupBy(series, b.alias("bucket")).agg(F.max(F.abs(x)).alias("p"), F.sqrt(F.avg(x * x)).alias("r"))
    return per.select(series, "bucket", quantize_amplitude(F.col("p")).alias("peak"), quantize_amplitude(F.col("r")).alias("rms"))


def slice_of(row: Column, n: Column, k: Column) -> Column:
    """In which of ``k`` slices ``[b*n/k, (b+1)*n/k)`` row ``row`` (from 0) of ``n`` lies."""
    return F.floor(((row + 1) * k - 1) / n).cast("bigint")


def downsample(df: DataFrame, series: str, bucket: str, peak: str, rms: str, width: int) -> DataFrame:
    """``series, column, peak, rms``: a waveform in ``width`` columns. Narrower than the waveform: column ``i`` covers
    ``[i*n/w, max(first+1, (i+1)*n/w))`` with the largest peak and the root mean square of rms; wider: points are repeated."""
    n = df.groupBy(series).agg((F.max(bucket) + 1).alias("n"))
    cols = n.select(series, "n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("column"))
    lo = F.floor(F.col("column") * F.col("n") / width)
    hi = F.greatest(lo + 1, F.floor((F.col("column") + 1) * F.col("n") / width))
    wide = F.least(F.col("n") - 1, lo)
    cols = cols.select(series, "column", F.explode(F.when(F.lit(width) >= F.col("n"), F.array(wide)).otherwise(F.sequence(lo, hi - 1))).alias("_b"))
    joined = cols.join(df.select(series, F.col(bucket).alias("_b"), peak, rms), [series, "_b"])
    return joined.groupBy(series, "column").agg(F.max(peak).alias("peak"), F.round(F.sqrt(F.avg(F.col(rms).cast("double") * F.col(rms)))).cast("int").alias("rms"))


def gated_loudness(df: DataFrame, series: str, frame: str, value: str, step: int, blocks: int = 4) -> DataFrame:
    """``series, n_blocks, lufs``: mean square over blocks of ``blocks * step`` frames, one every ``step``; blocks above the
    absolute gate (-70), then those of at least a tenth of their mean, are averaged. -70 where none is left. Frames are summed
    by ``step`` before any window, so the window sees one row a step. Values are taken as they are (no weighting filter)."""
    x = F.col(value).cast("double")
    steps = df.groupBy(series, F.floor(F.col(frame) / step).alias("s")).agg(F.sum(x * x).alias("e"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(series).orderBy("s").rowsBetween(-(blocks - 1), 0)
    energy = steps.select(series, F.sum("e").over(w).alias("e"), F.sum("n").over(w).alias("n")).where(F.col("n") == blocks * step).select(series, (F.col("e") / (blocks * step)).alias("e"))
    kept = energy.where(F.col("e") >= 10 ** ((-70 + 0.691) / 10))
    mean = kept.groupBy(series).agg(F.avg("e").alias("m"))
    last = kept.join(mean, series).where("e >= 0.1 * m").groupBy(series).agg(F.count(F.lit(1)).alias("n_blocks"), F.avg("e").alias("e"))
    every = df.select(series).distinct().join(last, series, "left")
    return every.select(series, F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce(F.greatest(F.lit(-70.0), 10 * F.log10("e") - 0.691), F.lit(-70.0)).alias("lufs"))


def resample(df: DataFrame, series: str, frame: str, value: str, source_rate: int, out_rate: int) -> DataFrame:
    """``series, frame, value`` at another rate by linear interpolation; output ``j`` lies at ``j * source / out``, as many as lie
    before the end. Frames meet their neighbours by a window, and outputs their frame by an equi-join."""
    w = Window.partitionBy(series).orderBy(frame)
    pairs = df.select(series, F.col(frame).alias("k"), F.col(value).cast("double").alias("x0"), F.coalesce(F.lead(F.col(value).cast("double")).over(w), F.col(value).cast("double")).alias("x1"))
    # output j lies between frames k and k + 1 for ceil(k*out/src) <= j < ceil((k+1)*out/src)
    ceil = lambda k: F.floor((k * out_rate + source_rate - 1) / source_rate)
    out = pairs.select(series, "k", "x0", "x1", ceil(F.col("k")).alias("lo"), ceil(F.col("k") + 1).alias("hi")).where("hi > lo")
    out = out.select(series, F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("j"), "k", "x0", "x1")
    frac = F.col("j") * float(source_rate) / float(out_rate) - F.col("k")
    return out.select(series, F.col("j").alias("frame"), (F.col("x0") + (F.col("x1") - F.col("x0")) * frac).alias("value"))


def patch_starts(n: Column, size: int, hop: int, policy: str = "drop") -> Column:
    """Starts of patches over ``n`` frames: only whole ones (``drop``), one more over the tail (``pad``), or one that ends with
    the series (``end``)."""
    whole = F.when(n >= size, F.sequence(F.lit(0), (F.floor((n - size) / hop) * hop).cast("int"), F.lit(hop))).otherwise(F.array().cast("array<int>"))
    if policy == "drop":
        return whole
    after = F.when(F.size(whole) == 0, F.lit(0)).otherwise(F.element_at(whole, -1) + hop)
    covered = F.when(F.size(whole) == 0, F.lit(0)).otherwise(F.element_at(whole, -1) + size)
    if policy == "pad":
        return F.when(covered < n, F.concat(whole, F.array(after.cast("int")))).otherwise(whole)
    if policy == "end":
        return F.when((covered < n) & (n >= size), F.concat(whole, F.array((n - size).cast("int")))).otherwise(whole)
    raise ValueError(policy)


def fill(v: Column, size: int, policy: str) -> Column:
    """An array brought to ``size`` by zeros (``zero``), its last value (``repeat``) or its mirror image (``reflect``)."""
    n = F.size(v)
    if policy == "zero":
        at = lambda i: F.when(i < n, F.get(v, i)).otherwise(F.lit(0.0))
    elif policy == "repeat":
        at = lambda i: F.get(v, F.least(i, n - 1))
    elif policy == "reflect":
        period = F.greatest(F.lit(1), 2 * n - 2)
        at = lambda i: F.get(v, F.least(i % period, period - i % period))
    else:
        raise ValueError(policy)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def overlap(out: DataFrame, inc: DataFrame, series: str, frame: str, value: str, out_from: int, fade: int) -> DataFrame:
    """``series, frame, value``: two streams mixed by position over ``fade`` frames from ``out_from`` with equal-power gains; a
    missing side counts as silence."""
    from carillon.functions.audio import equal_power

    a = out.where((F.col(frame) >= out_from) & (F.col(frame) < out_from + fade)).select(series, (F.col(frame) - out_from).alias("frame"), F.col(value).cast("double").alias("a"))
    b = inc.where(F.col(frame) < fade).select(series, F.col(frame).alias("frame"), F.col(value).cast("double").alias("b"))
    ga, gb = equal_power(F.col("frame") / float(fade))
    return a.join(b, [series, "frame"], "full_outer").select(series, "frame", (F.coalesce("a", F.lit(0.0)) * ga + F.coalesce("b", F.lit(0.0)) * gb).alias("value"))
