"""Scalars of levels, gains and positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_DB, FLOOR_LUFS = -60.0, -70.0
TARGET_LUFS, PEAK_CEILING_DB = -16.0, -1.0


def quantize_amplitude(a: Column) -> Column:
    """An amplitude as 0 (silent) to 255 (full scale), even in decibels above -60."""
    raw = F.round((20 * F.log10(a) - FLOOR_DB) / -FLOOR_DB * 254, 0) + 1
    return F.when(F.isnan(a) | (a <= 0), 0).when(a >= 1, 255).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(255.0), raw))).cast("int")


def db(x: Column, floor: float = FLOOR_LUFS) -> Column:
    """Decibels of a level, from ``floor`` up."""
    return F.when(x > 0, F.greatest(F.lit(floor), 20 * F.log10(x))).otherwise(F.lit(floor))


def db_to_linear(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 20.0)


def gain_db(measured: Column, target: float = TARGET_LUFS) -> Column:
    return F.lit(target) - measured


def normalization_gain(lufs: Column, peak_db: Column, target: float = TARGET_LUFS, ceiling: float = PEAK_CEILING_DB) -> Column:
    """Gain towards the target that keeps the peak under the ceiling; 0 where loudness isn't known."""
    want = gain_db(lufs, target)
    return F.when(lufs.isNull() | F.isnan(lufs), F.lit(0.0)).when(peak_db.isNull() | F.isnan(peak_db), want).otherwise(F.least(want, F.lit(ceiling) - peak_db))


def equal_power(t: Column) -> tuple[Column, Column]:
    """Gains of the outgoing and the incoming side at place ``t`` of a fade from 0 to 1."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (math.pi / 2)
    return F.cos(x), F.sin(x)


def sanitize_sample(x: Column) -> Column:
    """NaN as silence, infinities as full scale."""
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), 1.0).when(x == float("-inf"), -1.0).otherwise(x)


def int_pcm(x: Column, bits: int) -> Column:
    return x / float(1 << (bits - 1))


def valid_loudness(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & x.between(-70.0, 6.0), F.lit(False))


def energy_floor(median: Column) -> Column:
    return F.greatest(F.lit(0.02), 0.25 * median)


def check_count(seconds: float, per_bucket: float, n: Column) -> Column:
    """Buckets that cover ``seconds``, at least one and at most all."""
    return F.greatest(F.lit(1), F.least(F.lit(int(math.floor(seconds / per_bucket + 0.5))), n))


def clamp(x: Column, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(x, lit(high)))


def next_index(i: Column, n: Column, repeat: Column) -> Column:
    """The index after ``i`` under a repeat mode (off, one, all); null at the end."""
    return F.when(repeat == "one", i).when(i + 1 < n, i + 1).when(repeat == "all", F.lit(0))


def swap_facts(outgoing: Column, incoming: Column, start: Column) -> Column:
    """``overlap, rebase``: by how many frames two streams overlapped when the incoming one takes over, and by how many its playhead
    is moved up to where mixing began; neither is below 0."""
    zero = F.lit(0).cast("bigint")
    return F.struct(F.greatest(zero, outgoing - start).alias("overlap"), F.greatest(zero, start - incoming).alias("rebase"))
