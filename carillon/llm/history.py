"""New batches against all accepted history, through a segment index for edit distance.

``HistoryIndex`` is a written index that outlives the session. Its ``segments`` hold each different value once, with the package it
was first seen in: a digest cut into ``max_edits + 1`` pieces, each under a hash of field, length, place and text, its head for
shortened digests, and a release key as one piece. ``accept`` probes the index with a batch's substrings, verifies the hits by
bounded edit distance (0 included, so equal values are found the same way), resolves the packages of the batch alone, and appends
the batch's new values. Earlier records are never read, normalised, cut, compared or grouped again: ``records`` says of each the
first of its package when it came, and ``moves`` which packages a later record has joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carillon.operators.components import connected_components
from carillon.operators.skew import HEAVY_SHARE, lookup_join
from carillon.session import StageLog, drop_path, list_path, stage_path

DIGEST = 64
#: Edits that can be asked for, at most: a digest with so many digits too many or too few is still read as a whole one.
MOST_EDITS = 2
#: A shortened digest denotes the one it begins, from this many hex digits on.
HEAD = 12
#: Sizes, in bits, of the bitmap of a batch's probes by which the scan of the index leaves out what they can't hit: the least
#: that has 32 bits a probe, or the last: 16 MB at most, whatever the size of the index or the batch.
BITS = (20, 22, 24, 27)
ID_BITS = 42
# Fixed value: SHA-256 of no content.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def digest(c: Column) -> Column:
    """The digest that a value denotes, as lower hex, or its first digits if it is shortened. Whole digests may be hex in any case,
    with a scheme, 0x, colons, blanks or dashes in it, or base64; up to two digits too many are kept as they are typed; null for
    placeholders, zeros, the digest of no content."""
    t = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    bare = F.regexp_replace(t, r"(?i)^(?:sha-?256\s*[:=-]\s*|0x)", "")
    packed = F.lower(F.regexp_replace(F.regexp_replace(bare, r"(?:…|\.\.\.)$", ""), r"[\s:-]", ""))
    b64 = F.translate(F.regexp_replace(bare, "=+$", ""), "-_", "+/")
    unpacked = F.when(b64.rlike(r"^[A-Za-z0-9+/]{43}$"), F.lower(F.hex(F.try_to_binary(F.concat(b64, F.lit("=")), F.lit("base64")))))
    hexed = F.when(packed.rlike(f"^[0-9a-f]{{{HEAD},{DIGEST + MOST_EDITS}}}$"), packed).otherwise(unpacked)
    return F.when(~hexed.rlike("^0+$") & ~F.lit(EMPTY).startswith(hexed), hexed)


def catalogue_key(c: Column) -> Column:
    """A group or release key in one writing: ``mb:`` with 32 hex digits, or ``h:`` with a digest; null for anything else."""
    t = F.lower(F.regexp_replace(c, r"[\s\p{Z}]", ""))
    mb = F.regexp_replace(F.regexp_extract(t, r"^mb:(?:urn:uuid:)?\{?([0-9a-f-]+)\}?$", 1), "-", "")
    h = F.regexp_extract(t, r"^h:(?:sha-?256[:=-]|0x)?([0-9a-f]{64})$", 1)
    return F.when(F.length(mb) == 32, F.concat(F.lit("mb:"), mb)).when(h != "", F.concat(F.lit("h:"), h))


def identity_values(rows: DataFrame) -> DataFrame:
    """``rank, value``: one row per identity a record has. ``rank`` orders records by batch, then id; a null batch counts as the
    last; rows without an id are left out. The first letter of a value names its field."""
    rank = F.shiftleft(F.coalesce(F.col("batch_no").cast("bigint"), F.lit((1 << 20) - 1)), ID_BITS).bitwiseOR(F.col("vector_id"))
    rel, group = catalogue_key(F.col("release_key")), catalogue_key(F.col("group_key"))
    values = F.array(
        F.concat(F.lit("m"), digest(F.col("manifest_sha256"))),
        F.concat(F.lit("f"), digest(F.col("fingerprint"))),
        F.when(rel.startswith("mb:"), F.concat(F.lit("r"), rel)).otherwise(F.concat(F.lit("r"), rel, F.lit("|"), group)),
    )
    return rows.where("vector_id is not null").select(rank.alias("rank"), F.explode(F.array_compact(values)).alias("value")).distinct()


def cuts(length: int, max_edits: int) -> list[tuple[int, int]]:
    """Start and length of ``max_edits + 1`` even pieces."""
    n = max_edits + 1
    short, more = divmod(length, n)
    out, at = [], 0
    for k in range(n):
        size = short + (k >= n - more)
        out.append((at, size))
        at += size
    return out


def probe_starts(length: int, other: int, max_edits: int) -> list[tuple[int, int, int]]:
    """``(piece, start, size)``: the substrings of a text of ``length`` that can equal piece ``k`` of a text of length ``other``
    within ``max_edits``: a piece shifts by no more than the edits left of it, nor than those left over for its right side."""
    delta, out = length - other, []
    for k, (at, size) in enumerate(cuts(other, max_edits)):
        low = max(0, at - k, at + delta - (max_edits - k))
        high = min(length - size, at + k, at + delta + (max_edits - k))
        out += [(k, s, size) for s in range(low, high + 1)]
    return out


def _key(v: Column, length: int, piece: int, start: int, size: int) -> Column:
    return F.xxhash64(F.substring(v, 1, 1), F.lit(length), F.lit(piece), F.substring(v, start + 2, size))


def lengths(max_edits: int) -> range:
    """Lengths of digests that are read as whole."""
    return range(DIGEST - max_edits, DIGEST + max_edits + 1)


def _whole(v: Column, max_edits: int) -> Column:
    """Whether a digest's value (a letter, then digits) is read as whole."""
    return F.length(v) >= DIGEST - max_edits + 1


def _keys(v: Column, max_edits: int, among: set[int], of_length) -> Column:
    """A release key is one piece; a digest has its head and, if it is whole, the pieces that ``of_length`` names; ``among`` are the
    lengths that whole ones have."""
    none = F.array().cast("array<bigint>")
    pieces = F.when(F.lit(False), none)
    for n in sorted(among & set(lengths(max_edits))) if max_edits else ():
        pieces = pieces.when(F.length(v) == n + 1, F.array(*(_key(v, *p) for p in of_length(n))))
    whole = F.array(F.xxhash64(v))
    digests = F.concat(whole, F.array(_key(v, 0, -1, 0, HEAD)), F.coalesce(pieces, none))
    return F.when(F.substring(v, 1, 1) == "r", whole).otherwise(digests)


def segments(values: DataFrame, max_edits: int, among: set[int]) -> DataFrame:
    """``key`` for each piece that the index stores of ``value``, beside the other columns; ``among``: lengths of whole digests in it."""
    of_length = lambda n: [(n, k, at, size) for k, (at, size) in enumerate(cuts(n, max_edits))]
    return values.select(F.explode(F.array_distinct(_keys(F.col("value"), max_edits, among, of_length))).alias("key"), *values.columns)


def probes(values: DataFrame, max_edits: int, among: set[int], stored: set[int]) -> DataFrame:
    """``key, probe, first``: the substrings by which each value is looked up among stored ones of the lengths ``stored``."""
    near = [n for n in lengths(max_edits) if n in stored]
    of_length = lambda n: [(m, *p) for m in near if abs(m - n) <= max_edits for p in probe_starts(n, m, max_edits)]
    return values.select(F.explode(F.array_distinct(_keys(F.col("value"), max_edits, among, of_length))).alias("key"), F.col("value").alias("probe"), "first")


def _slot(key: str, bits: int) -> Column:
    return F.pmod(F.col(key), F.lit(1 << bits)) + 1


def sift(index: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    """The rows of ``index`` whose ``key`` may be among those of ``asked``: a broadcast bitmap of fixed size lets through all that
    are and few others, so of a long history little more than the hits is shuffled."""
    slot = _slot("key", bits)
    marks = asked.select(F.bitmap_bucket_number(slot).alias("_b"), F.bitmap_bit_position(slot).alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    byte = "cast(conv(hex(substring(_m, cast(_q div 8 as int) + 1, 1)), 16, 10) as int)"
    seen = index.withColumn("_b", F.bitmap_bucket_number(slot)).withColumn("_q", F.bitmap_bit_position(slot)).join(F.broadcast(marks), "_b")
    return seen.where(F.expr(f"shiftright({byte}, cast(_q % 8 as int)) & 1 = 1")).select(index.columns)


DONE = "max_edits int, lengths bigint, moved int, batches array<string>"


class HistoryIndex:
    """The written index under ``path``, with all that was accepted there before, in this session or another. ``max_edits``: edits
    within which two whole digests count as one that was mistyped; it must stay what it was when the index was begun."""

    def __init__(self, spark: SparkSession, path: str | None = None, max_edits: int = 2):
        if not 0 <= max_edits <= MOST_EDITS:
            raise ValueError(f"max_edits is from 0 to {MOST_EDITS}")
        self.spark, self.path, self.max_edits = spark, path or stage_path(spark, "history"), max_edits
        self.parts: list[str] = [b for b in list_path(spark, f"{self.path}/done") if not b.startswith(("_", "."))]
        self.batches, self.stored, self.moved = set(), set(), 0
        if self.parts:  # one row a part
            done = spark.read.schema(DONE).parquet(*(f"{self.path}/done/{b}" for b in self.parts)).collect()
            if {r.max_edits for r in done} != {max_edits}:
                raise ValueError("the index was begun with another max_edits")
            self.stored = {n for r in done for n in lengths(max_edits) if r.lengths >> (n - DIGEST + MOST_EDITS) & 1}
            self.moved = max(r.moved for r in done)
            self.batches = {b for r in done for b in r.batches}

    def _read(self, name: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{name}/{b}" for b in self.parts]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{batch}")

    def moves(self) -> DataFrame:
        """``old, new``: firsts of packages that a later record has joined to an earlier package, each with its first as of now."""
        schema = "old bigint, new bigint"
        return self.spark.read.schema(schema).parquet(f"{self.path}/moves/{self.moved}") if self.moved else self.spark.createDataFrame([], schema)

    def accept(self, rows: DataFrame, *batches: str) -> None:
        """Compare one batch, or several that wait, with all accepted before and with each other, and append them: whether batches
        come one by one or together, the packages are the same. An empty batch adds nothing; if all names were accepted before,
        nothing changes; what was broken off can be accepted anew. The work grows with what is new; of the history the segments
        are scanned under a bitmap, and only those that may be hit go any further."""
        if not set(batches) - self.batches:
            return
        if set(batches) & self.batches:
            raise ValueError(f"accepted before: {sorted(set(batches) & self.batches)}")
        batch = batches[0] if len(batches) == 1 else f"{batches[0]}-and-{len(batches) - 1}-more"
        spark, log = self.spark, StageLog(self.spark)
        own = log.stage(identity_values(rows), "p1-own")
        counted = Observation()
        length = F.when(~F.startswith("value", F.lit("r")) & F.length("value").between(DIGEST - MOST_EDITS + 1, DIGEST + MOST_EDITS + 1), F.length("value") - 1 - (DIGEST - MOST_EDITS))
        firsts = own.groupBy("value").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
        firsts = firsts.observe(counted, F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"), F.max("n").alias("most"), *(F.max((length == k).cast("int")).alias(f"l{k}") for k in range(2 * MOST_EDITS + 1)))
        firsts = log.stage(firsts, "p1-firsts")
        seen = counted.get
        mine = {k + DIGEST - MOST_EDITS for k in range(2 * MOST_EDITS + 1) if seen[f"l{k}"]}
        asked = probes(firsts, self.max_edits, mine, self.stored | mine)
        own_segments = segments(firsts.select("value", "first"), self.max_edits, mine).withColumnRenamed("first", "owner")
        # inside the batch equal values are one already
        hits = own_segments.join(asked.hint("merge"), "key").where("value <> probe").withColumn("old", F.lit(False))
        if self.parts:
            bits = next((b for b in BITS if 256 * seen["values"] <= 1 << b), BITS[-1])
            history = self._read("segments", "key bigint, value string, owner bigint")
            # the sizes of exploded rows are guessed too low, so the join is told not to broadcast them
            hits = hits.unionByName(sift(history, asked, bits).join(asked.hint("merge"), "key").withColumn("old", F.lit(True)))
        hits = log.stage(hits.where("substring(value, 1, 1) = substring(probe, 1, 1)").select("probe", "first", "value", "owner", "old").distinct(), "p1-hits")
        found = self._verified(hits)
        # the packages that are hit, as they are now
        if self.moved:
            found = found.join(self.moves().withColumnRenamed("old", "owner"), "owner", "left").withColumn("owner", F.coalesce("new", "owner")).drop("new")
        found = log.stage(found.select("probe", "first", "value", "owner", "old"), "p1-found")
        heavy = firsts.where(F.col("n") > max(10_000, (seen["n"] or 0) // HEAVY_SHARE)).select("value") if (seen["most"] or 0) > 10_000 else None  # at most HEAVY_SHARE values
        inside = lookup_join(own, firsts.select("value", "first"), "value", heavy).where("rank <> first").select(F.col("rank").alias("src"), F.col("first").alias("dst"))
        comp = connected_components(inside.unionByName(found.select(F.col("first").alias("src"), F.col("owner").alias("dst"))), log=log)
        former = found.where("old").select(F.col("owner").alias("node")).distinct()
        joined, n_joined = comp.where("node <> root").join(former, "node", "left_semi").select(F.col("node").alias("old"), F.col("root").alias("new")), Observation()
        joined = log.stage(joined.observe(n_joined, F.count(F.lit(1)).alias("n")), "p1-moves")
        self._write(comp.where("node <> root").join(former, "node", "left_anti").select(F.col("node").alias("rank"), F.col("root").alias("first")), "records", batch)
        known = found.where("old and value = probe").select("value").distinct()
        new = firsts.select("value", "first").join(known, "value", "left_anti").join(comp.withColumnRenamed("node", "first"), "first", "left")
        new = new.select("value", F.coalesce("root", "first").alias("owner"))
        self._write(segments(new, self.max_edits, mine), "segments", batch)
        moved = self.moved
        if n_joined.get["n"]:
            # as many rows as packages that were ever joined; earlier targets that have moved now are followed
            later = joined.select(F.col("old").alias("new"), F.col("new").alias("newer"))
            every = self.moves().join(later, "new", "left").select("old", F.coalesce("newer", "new").alias("new")).unionByName(joined)
            moved = len(self.parts) + 1
            every.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/moves/{moved}")
        bits = sum(1 << k for k in range(2 * MOST_EDITS + 1) if seen[f"l{k}"])
        self._write(spark.createDataFrame([(self.max_edits, bits, moved, sorted(batches))], DONE).coalesce(1), "done", batch)
        if moved != self.moved and self.moved:
            drop_path(spark, f"{self.path}/moves/{self.moved}")
        self.parts.append(batch)
        self.batches |= set(batches)
        self.moved, self.stored = moved, self.stored | mine
        log.close()

    def _verified(self, hits: DataFrame) -> DataFrame:
        """Of the hits those that denote the same: equal, whole within ``max_edits``, or one beginning the other. A shortened digest
        that begins several whole ones when it first meets one denotes none of them; what it denoted before, it keeps."""
        value, probe = F.col("value"), F.col("probe")
        near = F.levenshtein(value, probe, self.max_edits) >= 0 if self.max_edits else value == probe
        both = _whole(value, self.max_edits) & _whole(probe, self.max_edits)
        # release keys are hit by equality alone
        begins = ~both & (value.startswith(probe) | probe.startswith(value)) & ~probe.startswith("r")
        sure = hits.where((value == probe) | both & near | begins & ~_whole(value, self.max_edits) & ~_whole(probe, self.max_edits))
        cut = hits.where(begins & (_whole(value, self.max_edits) | _whole(probe, self.max_edits)))
        cut = cut.withColumn("head", F.when(_whole(value, self.max_edits), probe).otherwise(value)).withColumn("full", F.when(_whole(value, self.max_edits), value).otherwise(probe))
        # whole ones that an earlier head begins beside the one that asks: they share its first digits, so it has hit them as well
        beside = cut.where("old and head = value").select("probe", "head").join(hits.where(_whole(value, self.max_edits)).select("probe", F.col("value").alias("full")), "probe").where(F.col("full").startswith(F.col("head"))).select("head", "full")
        vague = cut.select("head", "full").unionByName(beside).groupBy("head").agg(F.count_distinct("full").alias("n")).where("n > 1").select("head")
        return sure.unionByName(cut.join(vague, "head", "left_anti").select(sure.columns))

    def packages(self) -> DataFrame:
        """``first_rank, rank``: one row per record that isn't the first of its package. One pass over what is known of each record,
        joined to the packages that moved."""
        moves = self.moves()
        records = self._read("records", "rank bigint, first bigint").join(moves.withColumnRenamed("old", "first"), "first", "left")
        return records.select(F.coalesce("new", "first").alias("first_rank"), "rank").unionByName(moves.select(F.col("new").alias("first_rank"), F.col("old").alias("rank")))

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def first_of_package(rows: DataFrame, max_edits: int = 2, index: HistoryIndex | None = None) -> DataFrame:
    """``first_id, vector_id``: every record of a package already known, with the package's first record.

    Batch 0 is the accepted history; the later batches wait and are accepted together after it. Into a given ``index`` only batches
    go that it hasn't accepted; without one, the index is made for this call. Null keys and placeholders denote nothing; repeated rows count once;
    empty tables give no rows; other columns aren't read.
    """
    spark = rows.sparkSession
    held = index or HistoryIndex(spark, max_edits=max_edits)
    # one number a batch comes to the driver
    numbers = sorted((r[0] for r in rows.select("batch_no").distinct().collect()), key=lambda x: (x is None, x))
    waiting = [k for k in numbers if f"batch-{k}" not in held.batches]
    for part in (waiting[:1], waiting[1:]):
        if part:
            among = F.col("batch_no").isin([k for k in part if k is not None])
            held.accept(rows.where(among | F.col("batch_no").isNull() if None in part else among), *(f"batch-{k}" for k in part))
    low = F.lit((1 << ID_BITS) - 1)
    found = held.packages().select(F.col("first_rank").bitwiseAND(low).alias("first_id"), F.col("rank").bitwiseAND(low).alias("vector_id"))
    if index is None:
        log = StageLog(spark)
        found = log.stage(found, "p1-packages")
        held.drop()
    return found
