"""Sampled signals and spectrograms in array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def resampled(signal: Column, source: int, target: int) -> Column:
    """Linear interpolation at int(n * target / source) places, each in the middle of its share."""
    n = F.size(signal)
    m = F.floor(n * F.lit(target / source)).cast("int")

    def at(i: Column) -> Column:
        place = F.greatest((i + 0.5) * (n / m) - 0.5, F.lit(0.0))
        low = F.floor(place)
        share = place - low
        return F.element_at(signal, (low + 1).cast("int")) * (1 - share) + F.element_at(signal, F.least(low + 2, n).cast("int")) * share

    if source == target:
        return signal
    return F.when(m > 0, F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<double>"))


def mel_bins(rate: int, size: int, bands: int) -> list[int]:
    """Frequency bins of the edges of ``bands`` triangles, evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hertz = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    return np.floor((size + 1) * hertz / rate).astype(int).tolist()


def mel_filters(spark: SparkSession, rate: int, size: int, bands: int) -> DataFrame:
    """(band, bin, weight): the triangles' weights that are not 0."""
    bins = mel_bins(rate, size, bands)
    edges = spark.createDataFrame([(i, *bins[i : i + 3]) for i in range(bands)], "band int, low int, mid int, high int")
    each = edges.where("high > low").withColumn("bin", F.explode(F.sequence("low", F.col("high") - 1)))
    weight = F.when(F.col("bin") < F.col("mid"), (F.col("bin") - F.col("low")) / (F.col("mid") - F.col("low"))).otherwise((F.col("high") - F.col("bin")) / (F.col("high") - F.col("mid")))
    return each.select("band", "bin", weight.alias("weight")).where("weight > 0")


def log_mel(signal: Column, rate: int = 16_000, size: int = 400, hop: int = 160, bands: int = 80) -> Column:
    """The log-mel spectrogram of a signal, an array of bands for each frame: Hann windows
    around every hop, reflected at the ends; tenths logarithms, the range cut to 8, scaled."""
    bins = mel_bins(rate, size, bands)
    filters = np.zeros((bands, size // 2 + 1))
    for i in range(bands):
        low, mid, high = bins[i : i + 3]
        for j in range(low, high):
            filters[i, j] = (j - low) / (mid - low) if j < mid else (high - j) / (high - mid)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def run(col: pd.Series) -> pd.Series:
        out = []
        for x in col:
            x = np.asarray(x if x is not None else [], float)
            if len(x) <= size // 2:
                out.append([])
                continue
            x = np.pad(x, size // 2, mode="reflect")
            frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
            power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
            mel = np.log10(np.maximum(power @ filters.T, 1e-10))
            out.append(((np.maximum(mel, mel.max() - 8) + 4) / 4).tolist())
        return pd.Series(out, dtype=object)

    return run(signal)


def masked(frames: Column, times: list[tuple[Column, Column]], bands: list[tuple[Column, Column]]) -> Column:
    """frames (an array of bands for each time) with 0 in runs of times and of bands, each
    given by its first place (from 0) and its width."""

    def inside(i: Column, runs: list[tuple[Column, Column]]) -> Column:
        out = F.lit(False)
        for first, width in runs:
            out = out | ((i >= first) & (i < first + width))
        return out

    return F.transform(frames, lambda row, t: F.transform(row, lambda x, b: F.when(inside(t, times) | inside(b, bands), F.lit(0.0)).otherwise(x)))


def drawn(key: Column, salt: str, low: int, high: Column) -> Column:
    """A whole number from low to high (low, if that is more), by a hash of the key."""
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return (low + F.pmod(u, F.greatest(high - low + 1, F.lit(1)))).cast("int")
