"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter and stays where it is."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carillon.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str | None = None):
    """The byte-level encoder whose ranks are in ``path``, loaded once a process. ``pattern`` cuts texts before; None for the one that
    comes with the vocabularies."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern or _pattern(), mergeable_ranks=ranks, special_tokens={})


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_SENT: dict[str, str] = {}


def _send(docs: DataFrame, path: str) -> str:
    """The vocabulary's name among the session's files: it is sent to the workers once, so only the driver must have it."""
    sc = docs.sparkSession.sparkContext
    if _SENT.get(path) != sc.applicationId:
        sc.addFile(path)
        _SENT[path] = sc.applicationId
    return path.rsplit("/", 1)[-1]


def with_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text`` but with its number of tokens: whole texts, 0 for null and empty ones. Of the other columns the
    caller selects those it wants first; they may have any names but ``out``."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*(F.col(f"`{c}`") for c in rest)).schema.add(out, T.IntegerType())
    name, pattern = _send(docs, vocabulary), _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name), pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int32())], [*rest, out])

    return spread(docs).mapInArrow(run, schema)
