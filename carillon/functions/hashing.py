"""Digests, keys and splits derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carillon.functions.text import anchor

# The field tags of identity hashes.
TITLE, DATE, TYPE, ARTIST_NAME, ARTIST_ROLE, EDITION, RELEASE_DATE, COUNTRY, LABEL, CATALOGUE, BARCODE = range(1, 12)


def field(tag: int, c: Column) -> Column:
    """Tag, four bytes of length, bytes. Null gives nothing, an empty text a length of zero."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0"))
    return F.coalesce(F.concat(F.unhex(F.lit(f"{tag:02x}")), size, F.encode(c, "UTF-8")), F.unhex(F.lit("")))


def group_key(mbid: Column, title: Column, date: Column, kind: Column, artists: Column) -> Column:
    """A group's key: its anchor, or the hash of title, date, type and the artists (``name, role``) in byte order."""
    ordered = F.array_sort(artists, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1)
                           .when(F.coalesce(a["role"], F.lit("")) < F.coalesce(b["role"], F.lit("")), -1).when(F.coalesce(a["role"], F.lit("")) > F.coalesce(b["role"], F.lit("")), 1).otherwise(0))
    credits = F.aggregate(ordered, F.unhex(F.lit("")), lambda s, a: F.concat(s, field(ARTIST_NAME, a["name"]), field(ARTIST_ROLE, a["role"])))
    buf = F.concat(field(TITLE, title), field(DATE, date), field(TYPE, kind), F.coalesce(credits, F.unhex(F.lit(""))))
    return F.coalesce(F.concat(F.lit("mb:"), anchor(mbid)), F.concat(F.lit("h:"), F.sha2(buf, 256)))


def release_key(mbid: Column, edition: Column, date: Column, country: Column, label: Column, catalogue: Column, barcode: Column) -> Column:
    """A release's key within its group: its anchor, or the hash of what tells editions apart."""
    parts = ((EDITION, edition), (RELEASE_DATE, date), (COUNTRY, country), (LABEL, label), (CATALOGUE, catalogue), (BARCODE, barcode))
    return F.coalesce(F.concat(F.lit("mb:"), anchor(mbid)), F.concat(F.lit("h:"), F.sha2(F.concat(*(field(t, c) for t, c in parts)), 256)))


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def byte_of(digest: Column, k: int) -> Column:
    """Byte ``k`` (from 0) of a hex digest."""
    return F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")


def assign_split(key: Column, train: int, validation: int) -> Column:
    """train, validation or test by the first byte of the key's digest, in hundredths."""
    if not 0 <= train <= 100 or not 0 <= validation or train + validation > 100:
        raise ValueError("shares must be from 0 to 100 together")
    slot = F.floor(byte_of(F.sha2(key, 256), 0) * 100 / 256)
    return F.when(slot < train, F.lit("train")).when(slot < train + validation, F.lit("validation")).otherwise(F.lit("test"))


def target_bits(key: Column, bits: int = 52) -> Column:
    """The first ``bits`` bits of a key's digest, as an array of 0 and 1."""
    d = F.sha2(key, 256)
    digit = lambda i: F.conv(F.substring(d, (F.floor(i / 4) + 1).cast("int"), F.lit(1)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.floor(digit(i) / F.pow(F.lit(2), 3 - i % 4)).cast("int") % 2)


def uniform(seed: Column, counter: Column) -> Column:
    """A number in [0, 1) from a digest in counter mode: the first 52 bits of sha256(seed:counter)."""
    d = F.sha2(F.concat_ws(":", seed, counter.cast("string")), 256)
    return F.conv(F.substring(d, 1, 13), 16, 10).cast("double") / float(1 << 52)
