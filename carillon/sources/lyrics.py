"""Timed lyrics: whole documents to lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of a document, and of an offset in milliseconds.
MOST_BYTES, MOST_LINES, MOST_LINE_BYTES, MOST_OFFSET = 512 * 1024, 10_000, 4096, 3_600_000
_STAMP = re.compile(r"([0-9]+):([0-5][0-9])(?:\.([0-9]{2,3}))?\Z")
_SHAPED = re.compile(r"[0-9+\-][^:]*:")
_SPACE = " \t\n\r\f"


class Fault(Exception):
    """Why a document can't be read."""


def stamp(token: str) -> int:
    m = _STAMP.match(token)
    if not m:
        raise Fault("malformed_timestamp")
    ms = (int(m[1]) * 60 + int(m[2])) * 1000 + int((m[3] or "0").ljust(3, "0"))
    if ms >= 2**63:
        raise Fault("malformed_timestamp")
    return ms


def _head(line: str) -> tuple[list[str], str]:
    tokens = []
    while line.startswith("[") and "]" in line:
        token, _, line = line[1:].partition("]")
        tokens.append(token)
    return tokens, line


def _plain(text: str) -> str:
    """Text without tags in angle brackets that are shaped like times; any other bracket is text."""
    out, at = [], 0
    while (k := text.find("<", at)) >= 0:
        end = text.find(">", k)
        out.append(text[at:k])
        if end >= 0 and _SHAPED.match(text[k + 1 : end]):
            at = end + 1
        else:
            out.append("<")
            at = k + 1
    return "".join(out) + text[at:]


def parse(text: str) -> tuple[bool, list[tuple[int | None, str]]]:
    """``timed, lines``: lines with their milliseconds in order, ties in the order of the document; or plain lines without.

    Lines before a timed one go to its front, lines after the last one to its end; several times on a line repeat its text; an
    offset, the last one given, moves all times. Raises ``Fault``."""
    if len(text.encode()) > MOST_BYTES:
        raise Fault("too_large")
    lines = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and not lines[-1]:
        lines.pop()
    if len(lines) > MOST_LINES:
        raise Fault("too_many_lines")
    offset, timed, waiting = 0, [], []
    for line in lines:
        if len(line.encode()) > MOST_LINE_BYTES:
            raise Fault("line_too_long")
        tokens, rest = _head(line.lstrip(_SPACE))
        times = []
        for t in tokens:
            if _SHAPED.match(t):
                times.append(stamp(t))
            elif t.partition(":")[0].strip().lower() == "offset" and ":" in t:
                m = re.fullmatch(r"[+-]?[0-9]+", t.partition(":")[2].strip())
                if not m or abs(int(m[0])) > MOST_OFFSET:
                    raise Fault("malformed_offset")
                offset = int(m[0])
        words = _plain(rest).strip(_SPACE)
        if times:
            block = "\n".join([*waiting, words])
            waiting = []
            timed += [(ms, block) for ms in times]
        elif words or not tokens:
            waiting.append(words)
    if not timed:
        return False, [(None, w) for w in waiting]
    moved = [(ms + offset, w) for ms, w in timed]
    if min(ms for ms, _ in moved) < 0:
        raise Fault("negative_timestamp")
    if waiting:
        moved[-1] = (moved[-1][0], "\n".join([moved[-1][1], *waiting]))
    return True, sorted(moved, key=lambda x: x[0])


SCHEMA = "doc_id bigint, error string, seq int, ts_ms bigint, text string"


def read_lyrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line (``SCHEMA``); a document with a fault gives one row with its code; null ones give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string())
        for b in batches:
            rows = []
            for k, body in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                try:
                    rows += [(k, None, n, ms, w) for n, (ms, w) in enumerate(parse(body)[1])]
                except Fault as e:
                    rows.append((k, str(e), None, None, None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "error", "seq", "ts_ms", "text"])

    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
