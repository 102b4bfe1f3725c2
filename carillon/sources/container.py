"""Packed containers as members: a header, then blocks of code, length, checksum and payload."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Magic, sizes and limits of the format; the checksum's polynomial and start.
MAGIC, MAJOR, HEADER, BLOCK, TAIL = b"MPAK", 1, 16, 14, 52
MOST_MEMBERS, MOST_PATH = 4096, 4096
POLYNOMIAL, START = 0x8005, 0xFFFF


def _table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1) ^ (POLYNOMIAL if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_CRC = _table()


def crc16(data: bytes) -> int:
    c = START
    for x in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ x]
    return c


def block(code: bytes, payload: bytes) -> bytes:
    head = code + struct.pack(">Q", len(payload))
    return head + struct.pack(">H", crc16(head)) + payload


def blocks(data: bytes) -> Iterator[tuple[bytes, int, int, bool]]:
    """``code, payload offset, length, resynced``: each block whose checksum and length hold; where one doesn't, the search goes on
    a byte further."""
    at, lost = HEADER, False
    while at + BLOCK <= len(data):
        head = data[at : at + 12]
        size = struct.unpack_from(">Q", data, at + 4)[0]
        if struct.unpack_from(">H", data, at + 12)[0] != crc16(head) or at + BLOCK + size > len(data):
            at, lost = at + 1, True
            continue
        yield head[:4], at + BLOCK, size, lost
        at += BLOCK + size


def path_ok(path: str) -> bool:
    parts = path.split("/")
    return 0 < len(path.encode()) <= MOST_PATH and not any(c in path for c in "\\:") and all(ord(c) >= 0x20 and ord(c) != 0x7F for c in path) and not any(p in ("", ".", "..") for p in parts)


def scan(data: bytes | None) -> tuple[str | None, list[tuple[str, str, int, int]]]:
    """``error, rows``: rows of ``kind, path, offset, length``. Kinds: member, duplicate (the first of a path stands), skipped (its
    path can't be used), manifest, index, tail, resync."""
    if data is None or len(data) < HEADER or data[:4] != MAGIC:
        return "bad_magic", []
    if data[4] != MAJOR:
        return "unsupported_version", []
    rows, seen, resynced = [], set(), False
    for code, at, size, lost in blocks(data):
        if lost and not resynced:
            resynced = True
            rows.append(("resync", None, at, 0))
        if code == b"DATA":
            n = struct.unpack_from(">H", data, at)[0] if size >= 2 else 0
            try:
                path = data[at + 2 : at + 2 + n].decode() if n and n + 2 <= size else ""
            except UnicodeDecodeError:
                path = ""
            if not path_ok(path):
                rows.append(("skipped", None, at, size))
            elif path in seen:
                rows.append(("duplicate", path, at + 2 + n, size - 2 - n))
            elif len(seen) >= MOST_MEMBERS:
                return "too_many_members", []
            else:
                seen.add(path)
                rows.append(("member", path, at + 2 + n, size - 2 - n))
        elif code in (b"MANF", b"INDX", b"TAIL"):
            rows.append(({b"MANF": "manifest", b"INDX": "index", b"TAIL": "tail"}[code], None, at, size))
    return None, rows


def index_entries(payload: bytes) -> list[tuple[str, int, int, str]] | None:
    """``path, offset, length, sha256`` of an index; None if it is malformed, unsorted or names a path twice."""
    try:
        (count,) = struct.unpack_from(">I", payload)
        at, out = 4, []
        for _ in range(count):
            (n,) = struct.unpack_from(">H", payload, at)
            path = payload[at + 2 : at + 2 + n].decode()
            offset, length = struct.unpack_from(">QQ", payload, at + 2 + n)
            digest = payload[at + 18 + n : at + 50 + n]
            if not path_ok(path) or len(digest) < 32 or out and out[-1][0] >= path:
                return None
            out.append((path, offset, length, digest.hex()))
            at += 50 + n
        return out if at == len(payload) else None
    except (struct.error, UnicodeDecodeError):
        return None


SCHEMA = "path string, error string, ord int, kind string, member string, offset bigint, length bigint"


def read_containers(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The blocks of each container in order (``SCHEMA``); an unreadable one gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        for b in batches:
            rows = []
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                error, found = scan(data)
                rows += [(p, error, 0, None, None, None, None)] if error else [(p, None, k, *r) for k, r in enumerate(found)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "error", "ord", "kind", "member", "offset", "length"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, SCHEMA)


def pack(members: list[tuple[str, bytes]], manifest: bytes = b"{}") -> bytes:
    """A container: header, manifest, the members in their order, an index sorted by path, and a tail with the whole size, the number
    of members, the index's place and the digest of all before the tail. Paths must be usable and stand once."""
    if len({p for p, _ in members}) < len(members) or not all(path_ok(p) for p, _ in members) or len(members) > MOST_MEMBERS:
        raise ValueError("a path stands twice or can't be used, or there are too many members")
    out = bytearray(MAGIC + bytes((MAJOR,)) + bytes(HEADER - 5)) + block(b"MANF", manifest)
    index = []
    for path, body in members:
        name = path.encode()
        index.append((path, len(out) + BLOCK + 2 + len(name), len(body), hashlib.sha256(body).digest()))
        out += block(b"DATA", struct.pack(">H", len(name)) + name + body)
    entries = b"".join(struct.pack(">H", len(p.encode())) + p.encode() + struct.pack(">QQ", at, n) + d for p, at, n, d in sorted(index))
    at = len(out)
    out += block(b"INDX", struct.pack(">I", len(index)) + entries)
    tail = struct.pack(">QIQ", len(out) + BLOCK + TAIL, len(index), at) + hashlib.sha256(out).digest()
    return bytes(out + block(b"TAIL", tail))


def pack_containers(cells: DataFrame, by: str, member: str = "member", content: str = "content") -> DataFrame:
    """``by, content``: the members of each container packed in the order of their paths; a container is one task's work, as it is one
    file. Members without content are left out."""
    rows = cells.where(F.col(content).isNotNull()).select(F.col(by).alias("k"), F.col(member).alias("m"), F.col(content).alias("c"))

    def run(t: pa.Table) -> pa.Table:
        held = sorted(zip(t["m"].to_pylist(), t["c"].to_pylist()))
        return pa.table({"k": t["k"].slice(0, 1), "content": pa.array([pack(held)], pa.binary())})

    return rows.groupBy("k").applyInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, content binary").withColumnRenamed("k", by)
