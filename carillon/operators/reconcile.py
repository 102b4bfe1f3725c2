"""Successive snapshots reconciled as whole-table transformations: the outcome is a new snapshot."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carillon.functions.text import ascii_lower
from carillon.operators.skew import HEAVY_SHARE, lookup_join


def upsert(old: DataFrame, new: DataFrame, keys: list[str], take: Column | None = None) -> DataFrame:
    """Old rows replaced by new ones of their key, new keys added. ``take`` (over ``old_*`` and ``new_*`` columns) tells for which
    keys in both the new row wins; where it is false or null the old one stays. Keys must be unique on both sides."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"old_{c}") for c in rest), F.lit(True).alias("_o"))
    n = new.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"new_{c}") for c in rest), F.lit(True).alias("_n"))
    both = o.join(n, [f"_k{i}" for i in range(len(keys))], "full_outer")
    wins = F.col("_n").isNotNull() & (F.col("_o").isNull() | (F.coalesce(take, F.lit(False)) if take is not None else F.lit(True)))
    return both.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *(F.when(wins, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in rest))


def replace_slice(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Rows of every owner in ``new`` replaced as a whole; other owners' stay."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def classify(old: DataFrame, new: DataFrame, key: str, digest: str, finger: str) -> DataFrame:
    """``key, action``: added, unchanged, updated, moved (a key new here whose fingerprint stood under a key that is gone, and of
    one such alone) or gone. Null digests are never unchanged."""
    o = old.select(F.col(key).alias("k"), F.col(digest).alias("od"), F.col(finger).alias("of"), F.lit(True).alias("_o"))
    n = new.select(F.col(key).alias("k"), F.col(digest).alias("nd"), F.col(finger).alias("nf"), F.lit(True).alias("_n"))
    both = o.join(n, "k", "full_outer")
    gone = both.where("_n is null and of is not null").groupBy(F.col("of").alias("nf")).agg(F.count(F.lit(1)).alias("_c")).where("_c = 1").select("nf", F.lit(True).alias("_m"))
    fresh = both.where("_o is null").join(gone, "nf", "left")
    first = F.row_number().over(Window.partitionBy("nf").orderBy("k")) == 1
    fresh = fresh.select("k", F.when(F.col("_m") & first, F.lit("moved")).otherwise(F.lit("added")).alias("action"))
    kept = both.where("_o is not null").select("k", F.when(F.col("_n").isNull(), F.lit("gone")).when(F.col("od") == F.col("nd"), F.lit("unchanged")).otherwise(F.lit("updated")).alias("action"))
    return fresh.unionByName(kept).withColumnRenamed("k", key)


def sweep(old: DataFrame, seen: DataFrame, key: str, status: str, gone: str = "unavailable", keep: tuple[str, ...] = ("conflict",)) -> DataFrame:
    """Rows whose key wasn't seen get the status ``gone``, but for the statuses in ``keep``."""
    marked = old.join(seen.select(F.col(key)).distinct().withColumn("_s", F.lit(True)), key, "left")
    miss = F.col("_s").isNull() & ~F.coalesce(F.col(status).isin(*keep), F.lit(False))
    return marked.withColumn(status, F.when(miss, F.lit(gone)).otherwise(F.col(status))).drop("_s").select(old.columns)


def match_rows(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """``owner, new_id, old_id``: each new row (``pos, digest``), in the order of ``pos``, takes the unmatched old row of its owner at
    the same position with the same digest, else the only unmatched one with its digest, else none. Taking a row changes what
    is left, so an owner's rows are folded in order; owners are apart. Null and empty digests match nothing."""

    def fold(o: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        place = {}  # of each digest the unmatched rows and their positions, by id
        for i, p, d in sorted(zip(o["id"], o["pos"], o["digest"])):
            if d:
                place.setdefault(d, {})[i] = p
        out = []
        for p, i, d in sorted(zip(n["pos"], n["id"], n["digest"]), key=lambda r: r[:2]):
            left = place.get(d) or {}
            hit = next((k for k, q in left.items() if q == p), next(iter(left)) if len(left) == 1 else None)
            if hit is not None:
                del left[hit]
            out.append((i, hit))
        who = n["owner"].iloc[0] if len(n) else None
        return pd.DataFrame([(who, *r) for r in out], columns=["owner", "new_id", "old_id"]).astype({"old_id": "Int64"})

    side = lambda d: d.select(F.col(owner).cast("bigint").alias("owner"), F.col("id").cast("bigint").alias("id"), F.col("pos").cast("bigint").alias("pos"), F.col("digest").cast("string").alias("digest"))
    return side(old).groupBy("owner").cogroup(side(new).groupBy("owner")).applyInPandas(fold, "owner bigint, new_id bigint, old_id bigint")


def arbitrate(candidates: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """``key, path, outcome``: candidates of one identity in the order of their path: the first takes ownership if there is no
    present owner or it is the owner; one with the owner's fingerprint mirrors it, any other conflicts.

    The owner is settled beforehand (the present one's path, else the least), and all that changes on the way is its fingerprint,
    at its own path. So the fold is two aggregates a key, combined before the shuffle, and one join in which a frequent key's rows
    stand apart: an identity that a third of all candidates share is no task of its own. Null keys are left out.
    """
    o = owners.where(F.col("present")).groupBy(F.col(key).cast("string").alias("k")).agg(F.min("path").alias("_p"), F.min_by("fingerprint", "path").alias("_f"))
    c = candidates.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), "path", "fingerprint")
    first = c.groupBy("k").agg(F.min("path").alias("_least"), F.count(F.lit(1)).alias("_n"))
    keys = first.join(o, "k", "left").select("k", F.coalesce("_p", "_least").alias("owner"), F.col("_f").alias("before"), "_n")
    # the fingerprint from the owner's own candidate on
    now = c.join(keys.select("k", F.col("owner").alias("path")), ["k", "path"]).groupBy("k").agg(F.max("fingerprint").alias("after"))
    keys = keys.join(now, "k", "left").select("k", "owner", "before", F.coalesce("after", "before").alias("after"), "_n")
    total = c.count()
    heavy = keys.where(F.col("_n") > max(10_000, total // HEAVY_SHARE)).select("k") if total > 10_000 else None  # at most HEAVY_SHARE keys
    met = lookup_join(c, keys.drop("_n"), "k", heavy)
    held = F.when(F.col("path") < F.col("owner"), F.col("before")).otherwise(F.col("after"))
    what = F.when(F.col("path") == F.col("owner"), "owner").when(held.eqNullSafe(F.col("fingerprint")), "mirror").otherwise("conflict")
    return met.select("k", "path", what.alias("outcome"))


def upsert_artists(known: DataFrame, typed: DataFrame) -> DataFrame:
    """``id, name, sort_name, anchor``: the known artists (ids unique) after typed names (``name, sort_name, anchor``) were met: a typed
    name is the artist with its anchor, else the one of its exact name, else the one of its name in any case of A to Z, else a new
    one with a null id, to be numbered. What is stored is never overwritten: a missing sort name is filled, and a missing anchor
    of an artist met by name. Names that differ in case alone are one, with the least spelling, sort name and anchor; of several
    names with one anchor that no artist has, the first by name takes it and the others are that artist."""
    t = typed.where("name is not null").groupBy(ascii_lower(F.col("name")).alias("_l")).agg(F.min("name").alias("t_name"), F.min("sort_name").alias("t_sort"), F.min("anchor").alias("t_anchor"))
    anchors = known.where("anchor is not null").groupBy(F.col("anchor").alias("t_anchor")).agg(F.min("id").alias("i1"))
    names = known.groupBy(F.col("name").alias("t_name")).agg(F.min("id").alias("i2"))
    lows = known.groupBy(ascii_lower(F.col("name")).alias("_l")).agg(F.min("id").alias("i3"))
    met = t.join(anchors, "t_anchor", "left").join(names, "t_name", "left").join(lows, "_l", "left")
    held = known.select(F.col("id").alias("_i"), F.col("anchor").alias("_a"))
    met = met.withColumn("_i", F.coalesce("i2", "i3")).join(held, "_i", "left")
    # who takes an anchor that no artist has: the first by name whose artist lacks one, or who is new
    free = met.where("t_anchor is not null and i1 is null and _a is null").groupBy("t_anchor").agg(F.min("t_name").alias("_leader"), F.min_by("_i", "t_name").alias("_led"))
    met = met.join(free, "t_anchor", "left")
    follows = F.col("i1").isNull() & F.col("_leader").isNotNull() & (F.col("t_name") > F.col("_leader"))
    new_key = F.when(follows & F.col("_led").isNull(), F.col("_leader")).when(~follows & F.col("i1").isNull() & F.col("_i").isNull(), F.col("t_name"))
    met = met.select(F.coalesce("i1", F.when(follows, F.col("_led")).otherwise(F.col("_i"))).alias("id"), new_key.alias("_new"), "t_name", "t_sort", F.when(F.col("i1").isNull(), F.col("t_anchor")).alias("t_anchor"))
    fill = met.where("id is not null").groupBy("id").agg(F.min(F.when(F.col("t_sort").isNotNull(), F.struct("t_name", "t_sort"))).alias("_s"), F.min(F.when(F.col("t_anchor").isNotNull(), F.struct("t_name", "t_anchor"))).alias("_n"))
    old = known.select("id", "name", "sort_name", "anchor").join(fill, "id", "left").select("id", "name", F.coalesce("sort_name", "_s.t_sort").alias("sort_name"), F.coalesce("anchor", "_n.t_anchor").alias("anchor"))
    fresh = met.where("id is null and _new is not null").groupBy(F.col("_new").alias("name")).agg(F.min(F.when(F.col("t_sort").isNotNull(), F.struct("t_name", "t_sort"))).alias("_s"), F.min("t_anchor").alias("anchor"))
    return old.unionByName(fresh.select(F.lit(None).cast(known.schema["id"].dataType).alias("id"), "name", F.col("_s.t_sort").alias("sort_name"), "anchor"))


def sync_rows(old: DataFrame, new: DataFrame, owner: str, keys: list[str], order: str) -> DataFrame:
    """``owner, old_order, new_order, action``: rows of an owner matched by ``keys``, null meeting null, the n-th of one key with the
    n-th (by ``order``): update, insert for those only in ``new``, delete for those only in ``old``."""
    def side(d: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(owner, *keys).orderBy(order)
        return d.select(*(F.col(k).alias(f"{name}_{i}") for i, k in enumerate([owner, *keys])), F.col(order).alias(f"{name}_order"), F.row_number().over(w).alias(f"{name}_n"))

    o, n = side(old, "old"), side(new, "new")
    same = F.col("old_n") == F.col("new_n")
    for i in range(len(keys) + 1):
        same &= F.col(f"old_{i}").eqNullSafe(F.col(f"new_{i}"))
    what = F.when(F.col("old_n").isNull(), "insert").when(F.col("new_n").isNull(), "delete").otherwise("update")
    return o.join(n, same, "full_outer").select(F.coalesce("old_0", "new_0").alias(owner), "old_order", "new_order", what.alias("action"))


def scan_actions(packages: DataFrame, candidates: DataFrame, verify: bool = False) -> DataFrame:
    """``path, action, status, verify_status, last_error``: what a scan does with each candidate, given the packages on record.

    ``packages``: ``path`` (unique), ``status, verify_status, manifest_sha256, fingerprint``. ``candidates``: ``path`` (unique), ``body``
    (valid, invalid, unreadable), ``manifest_sha256, fingerprint, missing, errors, warnings``. Actions: invalid; refresh (an invalid
    one unchanged) and unchanged, both without ``verify`` only; moved (no package stands at the path, and the first by path of those
    with its fingerprint stands where nothing was found; the first candidate by path takes it); ingest.
    """
    c = candidates.select("path", "body", F.col("manifest_sha256").alias("sha"), F.col("fingerprint").alias("finger"), "missing", "errors", "warnings")
    p = packages.select("path", F.col("status").alias("had"), F.col("verify_status").alias("had_verify"), F.col("manifest_sha256").alias("had_sha"), F.lit(True).alias("on_record"))
    first = packages.where("fingerprint is not null").groupBy(F.col("fingerprint").alias("finger")).agg(F.min_by(F.struct("path", "status"), "path").alias("from"))
    gone = first.join(c.select(F.col("path").alias("here")), F.col("from.path") == F.col("here"), "left_anti")
    j = c.join(p, "path", "left")
    takers = j.where("on_record is null and body = 'valid'").groupBy("finger").agg(F.min("path").alias("taker")).join(gone, "finger").select(F.col("taker").alias("path"), F.col("from.status").alias("moved_status"), F.lit(True).alias("takes"))
    j = j.join(takers, "path", "left")
    same = F.lit(not verify) & F.coalesce(F.col("had_sha") == F.col("sha"), F.lit(False))
    action = (
        F.when(F.col("body") == "unreadable", "invalid").when(same & (F.col("had") == "invalid"), "refresh").when(F.col("body") == "invalid", "invalid")
        .when(same, "unchanged").when(F.col("takes"), "moved").otherwise("ingest"))
    lost, none = F.col("missing") > 0, F.lit(None).cast("string")
    faults = F.format_string("integrity verification failed (%d errors, %d warnings)", "errors", "warnings")
    if verify:
        found = [F.when(F.col("errors") > 0, x).when(F.col("warnings") > 0, y).otherwise(z) for x, y, z in (("checksum-failed", "warning", "valid"), ("checksum-failed", "warning", "valid"), (faults, F.format_string("%d warning(s)", "warnings"), none))]
    else:
        found = [F.when(lost, "warning").otherwise("valid"), F.lit("unverified"), F.when(lost, F.format_string("%d referenced object(s) missing", "missing"))]
    held = F.coalesce(F.col("moved_status") == "conflict", F.lit(False)) & (F.col("action") == "moved")
    j = j.withColumn("action", action)
    pick = lambda invalid, refresh, unchanged, conflict, other: (
        F.when(F.col("action") == "invalid", invalid).when(F.col("action") == "refresh", refresh).when(F.col("action") == "unchanged", unchanged).when(held, conflict).otherwise(other))
    return j.select(
        "path", "action",
        pick(F.lit("invalid"), F.col("had"), F.when(lost, "warning").when(F.col("had") == "unavailable", "valid").otherwise(F.col("had")), F.lit("conflict"), found[0]).alias("status"),
        pick(F.lit("unverified"), F.col("had_verify"), F.when(lost, "unverified").otherwise(F.col("had_verify")), F.lit("unverified"), found[1]).alias("verify_status"),
        pick(F.when(F.col("body") == "unreadable", "manifest unreadable").otherwise("manifest parse/validation failed"), none, F.when(lost, "referenced object(s) missing"), F.lit("identity conflict with active package owning this release"), found[2]).alias("last_error"))


def present(status: Column) -> Column:
    """Whether a package stands where it was found; a null status is not present, as NOT IN has it."""
    return ~F.coalesce(status.isin("unavailable", "invalid", "conflict"), F.lit(True))


def set_verified(packages: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Packages with the status and verify status of their verdict, unless they are in conflict or have none (a null status is
    changed by none)."""
    v = verdicts.select(key, F.col("status").alias("_s"), F.col("verify_status").alias("_v"), F.lit(True).alias("_has"))
    takes = F.coalesce(F.col("_has") & (F.col("status") != "conflict"), F.lit(False))
    return packages.join(v, key, "left").withColumns({"status": F.when(takes, F.col("_s")).otherwise(F.col("status")), "verify_status": F.when(takes, F.col("_v")).otherwise(F.col("verify_status"))}).drop("_s", "_v", "_has")


def ensure_sets(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fingerprint, id, outcome``: of each wanted set (``fingerprint, dimensions, encoding``) the one on record; refused where that has
    another shape, to be added (inactive) where there is none. Of repeated wishes with one fingerprint the least shape counts."""
    w = wanted.groupBy("fingerprint").agg(F.min(F.struct("dimensions", "encoding")).alias("w"))
    had = sets.select("fingerprint", "id", F.struct("dimensions", "encoding").alias("h"))
    what = F.when(F.col("id").isNull(), "added").when(F.col("h") == F.col("w"), "reused").otherwise("refused")
    return w.join(had, "fingerprint", "left").select("fingerprint", F.when(what != "refused", F.col("id")).alias("id"), what.alias("outcome"))


def link_or_add(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``name, anchor, id``: for each distinct typed name the known artist it means: by anchor, else by exact name, else by the
    name in any case of A to Z; null where none does (to be added). In each step the smallest id wins; names that differ in case
    alone are one, and keep the least spelling and the least anchor of theirs."""
    folded = rows.where("name is not null").groupBy(ascii_lower(F.col("name")).alias("_l")).agg(F.min("name").alias("name"), F.min("anchor").alias("anchor"))
    by_anchor = known.where("anchor is not null").groupBy(F.col("anchor").alias("anchor")).agg(F.min("id").alias("i1"))
    by_name = known.groupBy("name").agg(F.min("id").alias("i2"))
    by_low = known.groupBy(ascii_lower(F.col("name")).alias("_l")).agg(F.min("id").alias("i3"))
    return folded.join(by_anchor, "anchor", "left").join(by_name, "name", "left").join(by_low, "_l", "left").select("name", "anchor", F.coalesce("i1", "i2", "i3").alias("id"))


def unique_names(df: DataFrame, name: str, order: list[Column], out: str = "unique_name") -> DataFrame:
    """Names made unique: the first keeps its own, later ones get `` (2)``, `` (3)`` and so on."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(out, F.when(r == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), r.cast("string"), F.lit(")"))))


def upgrade(df: DataFrame, version: int, steps: list) -> DataFrame:
    """A table of an older schema version brought to the newest by the steps after its own; a newer version is refused."""
    if version > len(steps):
        raise ValueError(f"schema version {version} is newer than {len(steps)}")
    for step in steps[version:]:
        df = step(df)
    return df


