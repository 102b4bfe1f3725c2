"""Embedding documents: a 64-byte header, a table of 12-byte members, then the vectors of members that are ok."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes, codes and limits of the format.
HEADER, ENTRY, MAGIC, MAJOR, MINOR = 64, 12, b"MSIM", 1, 0
F32, F16, MOST_DIMENSIONS, MOST_TRACKS = 1, 2, 4096, 16384
STATUS = ("ok", "insufficient_audio", "unsupported", "failed")

SCHEMA = "path string, error string, fingerprint string, disc int, track int, status string, vector array<float>"


def parse(data: bytes) -> tuple[str | None, str | None, list[tuple[int, int, str, np.ndarray | None]]]:
    """``error, fingerprint, members``: the first fault's code, or None and the members in their order."""

    def fail(code: str):
        return code, None, []

    if len(data) < HEADER:
        return fail("truncated_header")
    magic, major, minor, finger, dims, enc, flags, count = struct.unpack_from(">4sHH32sHBBI", data)
    checks = (
        (magic != MAGIC, "magic_invalid"), (major != MAJOR or minor > MINOR, "unsupported_version"), (flags or any(data[48:64]), "reserved_nonzero"), (not any(finger), "zero_fingerprint"),
        (dims == 0, "dimensions_zero"), (dims > MOST_DIMENSIONS, "dimensions_too_large"), (enc not in (F32, F16), "unsupported_encoding"), (count == 0, "track_count_zero"),
        (count > MOST_TRACKS, "track_count_too_large"), (len(data) < HEADER + ENTRY * count, "truncated_table"),
    )
    for wrong, code in checks:
        if wrong:
            return fail(code)
    table = list(struct.iter_unpack(">IIB3s", data[HEADER : HEADER + ENTRY * count]))
    for disc, track, status, rest in table:
        for wrong, code in ((any(rest), "reserved_nonzero"), (disc == 0 or track == 0, "invalid_member"), (status >= len(STATUS), "unknown_status")):
            if wrong:
                return fail(code)
    keys = [(d, t) for d, t, _, _ in table]
    if len(set(keys)) < len(keys):
        return fail("duplicate_member")
    if keys != sorted(keys):
        return fail("unsorted_table")
    good = sum(s == 0 for _, _, s, _ in table)
    body = data[HEADER + ENTRY * count :]
    need = good * dims * (4 if enc == F32 else 2)
    if len(body) != need:
        return fail("truncated" if len(body) < need else "trailing_bytes")
    x = np.frombuffer(body, "<f4" if enc == F32 else "<f2").reshape(good, dims)
    if not np.isfinite(x).all():
        return fail("non_finite_vector")
    rows = iter(x.astype("f4") if enc == F32 else [None] * good)  # half precision is recognised, its vectors aren't read
    return None, finger.hex(), [(d, t, STATUS[s], next(rows) if s == 0 else None) for d, t, s, _ in table]


def build(fingerprint: bytes, dims: int, members: list[tuple[int, int, str, np.ndarray | None]]) -> bytes:
    """A document, members ascending; the same members give the same bytes."""
    ordered = sorted(members, key=lambda m: m[:2])
    head = struct.pack(">4sHH32sHBBI", MAGIC, MAJOR, MINOR, fingerprint, dims, F32, 0, len(ordered)) + bytes(16)
    table = b"".join(struct.pack(">IIB3s", d, t, STATUS.index(s), bytes(3)) for d, t, s, _ in ordered)
    return head + table + b"".join(np.asarray(v, "<f4").tobytes() for _, _, s, v in ordered if s == "ok")


def read_documents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row a member (``SCHEMA``); an unreadable document gives one row with the code of its first fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float32()))
        for b in batches:
            rows = []
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                error, finger, members = parse(data or b"")
                rows += [(p, error, None, None, None, None, None)] if error else [(p, None, finger, d, t, s, v) for d, t, s, v in members]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "error", "fingerprint", "disc", "track", "status", "vector"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, SCHEMA)


def write_documents(members: DataFrame, by: str, dims: int) -> DataFrame:
    """``by, content``: one document per key of ``by, fingerprint, disc, track, status, vector``. A document holds at most 16,384
    members, so a key is bounded."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_TRACKS:
            raise ValueError("a document has at most 16,384 members")
        rows = [(int(r.disc), int(r.track), r.status, r.vector) for r in pdf.itertuples()]
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "content": [build(bytes.fromhex(pdf["fingerprint"].iloc[0]), dims, rows)]})

    kind = members.schema[by].dataType.simpleString()
    got = members.select(F.col(by).alias("k"), "fingerprint", "disc", "track", "status", "vector").groupBy("k").applyInPandas(run, f"k {kind}, content binary")
    return got.withColumnRenamed("k", by)


def floats(cell: Column) -> Column:
    """A binary column of little-endian float32 as an array; null for a length that isn't a multiple of four, and for none."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or len(x) % 4 or not len(x) else np.frombuffer(x, "<f4").tolist() for x in s], dtype=object)

    return run(cell)


def blob(vec: Column) -> Column:
    """An array of float as little-endian float32 bytes."""

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in s], dtype=object)

    return run(vec)
