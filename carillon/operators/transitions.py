"""From the energy contours at a boundary to the way two tracks are joined, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carillon.functions.audio import check_count, energy_floor

SILENCE, MIN_SILENCE_S, LOUD = 0.02, 1.2, 0.25
FADE_MIN_S, FADE_BASE_S, GRACE_S = 1.0, 6.0, 0.5


def median(v: Column) -> Column:
    """The middle of the sorted values, between the two middle ones for an even number; 0 if there are none."""
    s, n = F.array_sort(v), F.size(v)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)


def _tail_run(v: Column, floor: Column) -> Column:
    """How many values at the end lie below ``floor``."""
    last = F.array_max(F.transform(v, lambda x, i: F.when(x >= floor, i).otherwise(F.lit(-1))))
    return F.size(v) - 1 - F.coalesce(last, F.lit(-1))


def trailing_silence(tail: Column, per_bucket: float) -> Column:
    return _tail_run(tail, F.lit(SILENCE)) * per_bucket


def decay(tail: Column, per_bucket: float) -> Column:
    return _tail_run(tail, energy_floor(median(tail))) * per_bucket


def clean_loud_ending(tail: Column, per_bucket: float) -> Column:
    m, n = median(tail), F.size(tail)
    end = F.slice(tail, n - check_count(2.0, per_bucket, n) + 1, check_count(2.0, per_bucket, n))
    return F.when(n == 0, F.lit(False)).otherwise((F.element_at(tail, -1) >= energy_floor(m)) & F.forall(end, lambda x: x >= LOUD * m))


def fast_attack(head: Column, per_bucket: float) -> Column:
    n = F.size(head)
    return F.when(n == 0, F.lit(False)).otherwise(F.exists(F.slice(head, 1, check_count(0.3, per_bucket, n)), lambda x: x >= energy_floor(median(head))))


def plan(tail: Column, head: Column, out_seconds: Column, in_seconds: Column, max_fade: Column, repeat_one: Column, same_release: Column, per_bucket: float) -> Column:
    """``kind, seconds``: gapless, hard_cut, or fade with its length."""
    fade = F.greatest(F.lit(0.0), max_fade)
    length = F.least(fade, F.lit(FADE_BASE_S), decay(tail, per_bucket) + GRACE_S)
    length = F.least(F.greatest(F.least(F.lit(FADE_MIN_S), fade), length), fade)
    half = lambda s: F.when(s > 0, s / 2).otherwise(length)
    length = F.round(F.greatest(F.lit(0.0), F.least(length, half(out_seconds), half(in_seconds))) * 100) / 100
    clean = clean_loud_ending(tail, per_bucket)
    kind = (
        F.when((fade == 0) | F.coalesce(repeat_one, F.lit(False)), F.lit("gapless")).when(tail.isNull() | head.isNull(), F.lit("fade"))
        .when(trailing_silence(tail, per_bucket) >= MIN_SILENCE_S, F.lit("gapless")).when(F.coalesce(same_release, F.lit(False)) & clean, F.lit("gapless"))
        .when(clean & fast_attack(head, per_bucket), F.lit("hard_cut")).otherwise(F.lit("fade"))
    )
    return F.struct(kind.alias("kind"), F.when(kind == "fade", F.when(tail.isNull() | head.isNull(), fade).otherwise(length)).alias("seconds"))
