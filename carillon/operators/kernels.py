"""Signal kernels that are inherently sequential: NumPy per track, one task a track, never per time slice.

A track's samples come as rows ``(track, frame, channel, sample)``; a task holds one track, whose length bounds its memory."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR, OFFSET, TAPS = -70.0, 0.691, 49
# The two filters of the loudness standard, as frequency, gain in decibels and quality.
SHELF, SHELF_GAIN, SHELF_Q, SHELF_POWER = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416
PASS, PASS_Q = 38.13547087602444, 0.5003270373238773


def k_weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two second-order sections at a rate: feed-forward and feedback coefficients."""
    if rate <= 2 * SHELF:
        raise ValueError(f"the rate must be above {2 * SHELF:.0f}")
    k = np.tan(np.pi * SHELF / rate)
    high = 10 ** (SHELF_GAIN / 20)
    band = high**SHELF_POWER
    n = 1 + k / SHELF_Q + k * k
    shelf = np.array([high + band * k / SHELF_Q + k * k, 2 * (k * k - high), high - band * k / SHELF_Q + k * k]) / n, np.array([1, 2 * (k * k - 1) / n, (1 - k / SHELF_Q + k * k) / n])
    k = np.tan(np.pi * PASS / rate)
    n = 1 + k / PASS_Q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / n, (1 - k / PASS_Q + k * k) / n]))]


def filtered(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames by channels through both sections. The recursive filter's response is cut where it has died away (after a second it
    lies far below double precision) and applied by overlapping Fourier blocks, which NumPy runs over whole arrays."""
    size = min(max(rate, 16), 1 << 18)
    response = np.zeros(size)
    response[0] = 1.0
    for b, a in k_weighting(rate):
        out, y1, y2, x1, x2 = np.empty(size), 0.0, 0.0, 0.0, 0.0
        for k, v in enumerate(response.tolist()):
            y = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            x2, x1, y2, y1 = x1, v, y1, y
            out[k] = y
        response = out
    block = 1 << int(np.ceil(np.log2(2 * size)))
    spectrum, step = np.fft.rfft(response, block)[:, None], block - size + 1
    out = np.zeros((len(x) + block, x.shape[1]))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        out[at : at + block] += np.fft.irfft(np.fft.rfft(part, block, axis=0) * spectrum, block, axis=0)[: len(out) - at]
    return out[: len(x)]


def true_peak(x: np.ndarray, rate: int) -> float:
    """The largest magnitude between samples too: four or two times oversampled by a windowed sinc of 49 taps."""
    peak = float(np.abs(x).max(initial=0.0))
    factor = 4 if rate < 96_000 else 2 if rate < 192_000 else 1
    if factor == 1 or not len(x):
        return peak
    j = np.arange(TAPS)
    taps = np.sinc((j - (TAPS - 1) / 2) / factor) * 0.5 * (1 - np.cos(2 * np.pi * j / (TAPS - 1)))
    for phase in range(factor):
        part = taps[phase::factor]
        for c in range(x.shape[1]):
            peak = max(peak, float(np.abs(np.convolve(x[:, c], part)[: len(x)]).max()))
    return peak


def loudness_of(x: np.ndarray, rate: int) -> tuple[float, float]:
    """Integrated loudness and true peak in decibels of frames by channels."""
    x = np.nan_to_num(x, nan=0.0, posinf=1.0, neginf=-1.0)
    step = (rate + 5) // 10
    y = (filtered(x, rate) ** 2).sum(axis=1)
    sums = np.add.reduceat(y[: len(y) // step * step], np.arange(0, len(y) // step * step, step)) if len(y) >= step else np.zeros(0)
    energy = np.convolve(sums, np.ones(4), "valid") / (4 * step) if len(sums) >= 4 else np.zeros(0)
    kept = energy[energy >= 10 ** ((FLOOR + OFFSET) / 10)]
    kept = kept[kept >= 0.1 * kept.mean()] if len(kept) else kept
    lufs = max(FLOOR, 10 * np.log10(kept.mean()) - OFFSET) if len(kept) else FLOOR
    peak = true_peak(x, rate)
    return float(lufs), max(FLOOR, 20 * np.log10(peak)) if peak > 0 else FLOOR


def per_track(samples: DataFrame, track: str, kernel: Callable[[np.ndarray], list[tuple]], fields: str) -> DataFrame:
    """``kernel`` over each track's frames by channels; its rows, with the track before them."""
    kind = samples.schema[track].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((int(pdf["frame"].max()) + 1, int(pdf["channel"].max()) + 1))
        x[pdf["frame"].to_numpy(), pdf["channel"].to_numpy()] = pdf["sample"].to_numpy()
        return pd.DataFrame([(pdf["k"].iloc[0], *r) for r in kernel(x)], columns=["k", *names])

    got = samples.select(F.col(track).alias("k"), "frame", "channel", F.col("sample").cast("double").alias("sample")).groupBy("k").applyInPandas(run, f"k {kind}, {fields}")
    return got.withColumnRenamed("k", track)


def loudness(samples: DataFrame, track: str, rate: int) -> DataFrame:
    """``track, lufs, peak_db``."""
    return per_track(samples, track, lambda x: [loudness_of(x, rate)], "lufs double, peak_db double")


def mel_filters(bands: int, bins: int, high_hz: float) -> np.ndarray:
    """Triangles even in mel (linear below 1 kHz, logarithmic above), each divided by its area: bands by bins."""
    knee, per, log = 1000.0, 200.0 / 3.0, np.log(6.4) / 27.0
    to_hz = lambda m: np.where(m < knee / per, m * per, knee * np.exp(log * (m - knee / per)))
    top = high_hz / per if high_hz < knee else knee / per + np.log(high_hz / knee) / log
    edges = to_hz(np.linspace(0.0, top, bands + 2))
    f = np.arange(bins) * high_hz / (bins - 1)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(up, down)) / ((edges[2:] - edges[:-2]) / 2)[:, None]


def mel_frames(mono: np.ndarray, rate: int, size: int = 512, hop: int = 256, bands: int = 96) -> np.ndarray:
    """Whole frames through a Hann window, power spectrum, mel bands and ``log10(10000 x + 1)``: frames by bands."""
    n = max(0, 1 + (len(mono) - size) // hop) if len(mono) >= size else 0
    if not n:
        return np.zeros((0, bands))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(mono, size)[::hop][:n] * window, axis=1)) ** 2
    return np.log10(10_000 * (power @ mel_filters(bands, size // 2 + 1, rate / 2).T) + 1)


def mel_patches(samples: DataFrame, track: str, rate: int, frames: int = 187, stride: int = 93, bands: int = 96) -> DataFrame:
    """``track, patch, values``: patches of mel frames of the channels' mean, the tail left out."""

    def kernel(x: np.ndarray) -> list[tuple]:
        m = mel_frames(x.mean(axis=1), rate, bands=bands)
        return [(k, m[at : at + frames].ravel().tolist()) for k, at in enumerate(range(0, len(m) - frames + 1, stride))]

    return per_track(samples, track, kernel, "patch int, values array<double>")


class ByteStream:
    """Bytes of sha256(seed + counter) one after another, the counter as eight bytes."""

    def __init__(self, seed: str):
        self.seed, self.counter, self.rest = seed.encode(), 0, b""

    def take(self, n: int) -> bytes:
        while len(self.rest) < n:
            self.rest += hashlib.sha256(self.seed + self.counter.to_bytes(8, "big")).digest()
            self.counter += 1
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def unit(self) -> float:
        """A number in [0, 1) of 53 bits."""
        return (int.from_bytes(self.take(8), "big") >> 11) / (1 << 53)


def shuffled(n: int, seed: str) -> list[int]:
    """0 to n - 1 in an order drawn from a byte stream, each order as likely."""
    stream, order = ByteStream(seed), list(range(n))
    for k in range(n - 1, 0, -1):
        j = int(stream.unit() * (k + 1))
        order[k], order[j] = order[j], order[k]
    return order
