"""Sample streams and waveform envelopes in binary cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_wav(data: bytes) -> tuple[int, int, np.ndarray] | None:
    """``rate, channels, samples`` (frames by channels, float64 from -1 to 1) of a RIFF stream of 8, 16, 24 or 32 bit PCM or float32;
    None if it isn't one. A data chunk cut short gives the whole frames it has."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if tag == 0xFFFE and len(body) >= 26:
                tag = struct.unpack_from("<H", body, 24)[0]
            fmt = tag, channels, rate, bits
        elif name == b"data" and fmt:
            tag, channels, rate, bits = fmt
            width = bits // 8
            if not channels or not rate or (tag, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32)):
                return None
            body = body[: len(body) // (width * channels) * width * channels]
            if tag == 3:
                x = np.frombuffer(body, "<f4").astype("f8")
            elif bits == 8:
                x = (np.frombuffer(body, "u1").astype("f8") - 128) / 128
            elif bits == 24:
                raw = np.frombuffer(body, "u1").reshape(-1, 3).astype("i4")
                x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8).astype("f8") / (1 << 23)
            else:
                x = np.frombuffer(body, f"<i{width}").astype("f8") / (1 << (bits - 1))
            return rate, channels, x.reshape(-1, channels)
        at += 8 + size + (size & 1)
    return None


def encode_wav(samples: DataFrame, by: str, order: str, value: str, rate: int) -> DataFrame:
    """``by, content``: each key's samples, whole numbers of 16 bits in their order, as a mono WAV stream; one task a key, as it is one file."""
    kind = samples.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        body = np.clip(pdf.sort_values("o")["v"].to_numpy(), -(1 << 15), (1 << 15) - 1).astype("<i2").tobytes()
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body))
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "content": [head + body]})

    rows = samples.select(F.col(by).alias("k"), F.col(order).alias("o"), F.col(value).alias("v"))
    return rows.groupBy("k").applyInPandas(run, f"k {kind}, content binary").withColumnRenamed("k", by)


def wav_frames(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key, rate, frame, channel, sample``: one row a sample. Unreadable and null cells give no rows. A file is one task's work;
    files of any number spread over tasks."""
    schema = T.StructType([T.StructField(key, files.schema[key].dataType), *(T.StructField(n, t) for n, t in (("rate", T.IntegerType()), ("frame", T.LongType()), ("channel", T.IntegerType()), ("sample", T.DoubleType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, data in zip(pdf[key], pdf[content]):
                got = decode_wav(bytes(data)) if data is not None else None
                if got is None:
                    continue
                rate, channels, x = got
                for at in range(0, len(x), 65_536):  # bounded batches, whatever the file's length
                    part = x[at : at + 65_536]
                    yield pd.DataFrame({key: k, "rate": rate, "frame": np.repeat(np.arange(at, at + len(part)), channels), "channel": np.tile(np.arange(channels), len(part)), "sample": part.reshape(-1)})

    return files.select(key, content).mapInPandas(run, schema)


def encode_wfm(buckets: DataFrame, by: str, bucket: str = "bucket", peak: str = "peak", rms: str = "rms") -> DataFrame:
    """``by, content``: a waveform's payload, two bytes a bucket in order."""
    pair = F.concat(F.lpad(F.hex(F.col(peak).cast("bigint")), 2, "0"), F.lpad(F.hex(F.col(rms).cast("bigint")), 2, "0"))
    packed = buckets.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(bucket).alias("b"), pair.alias("p")))).alias("a"))
    return packed.select(by, F.unhex(F.array_join(F.transform("a", lambda x: x["p"]), "")).alias("content"))


def decode_wfm(df: DataFrame, by: str, content: str = "content") -> DataFrame:
    """``by, bucket, peak, rms`` of payloads; a payload of odd length gives no rows."""
    h = F.hex(content)
    at = lambda k: F.conv(F.substring(h, (F.col("bucket") * 4 + k).cast("int"), F.lit(2)), 16, 10).cast("int")
    good = df.where((F.octet_length(content) % 2 == 0) & (F.octet_length(content) > 0))
    rows = good.select(by, content, F.explode(F.sequence(F.lit(0), (F.octet_length(content) / 2 - 1).cast("int"))).alias("bucket"))
    return rows.select(by, "bucket", at(1).alias("peak"), at(3).alias("rms"))


def half_bits(v: Column) -> Column:
    """An array of float as half-precision bit patterns (round to nearest, ties to even); null where a number leaves the range."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            if x is None:
                out.append(None)
                continue
            x = np.asarray(x, "f4")
            with np.errstate(over="ignore"):
                h = x.astype("f2")
            out.append(h.view("u2").astype("i4").tolist() if np.isfinite(x).all() and np.isfinite(h).all() else None)
        return pd.Series(out, dtype=object)

    return run(v)


def from_half_bits(v: Column) -> Column:
    """Half-precision bit patterns as an array of float."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, "u2").view("f2").astype("f4").tolist() for x in s], dtype=object)

    return run(v)
