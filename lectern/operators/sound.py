"""Speech signals: pauses, quiet points, pitch, octave bands, resampling, stretching, mixing. Samples are ARRAY<FLOAT>, mono.

A clip is one row and fits in a task; clips are spread over tasks. Null and empty clips have null results. Placements of one
recording are mixed in one task, since their sum is one signal; recordings are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Step and window of levels, least pause, octave bands, bounds of pitch and corrections, breaths.
STEP_S, WINDOW_S, LEAST_PAUSE_S = 0.01, 0.02, 0.15
OCTAVES, BAND_FRAME, VOICED_DB = (125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0), 2048, -45.0
PITCH_RATE, PITCH_LOW, PITCH_HIGH, PITCH_STRENGTH = 16000, 65, 400, 0.45
PEAK, BREATH_LINE_S, BREATH_GAP_S = 0.98, 2.5, 0.22


def levels_db(x: np.ndarray, rate: int) -> np.ndarray:
    """Level of every step over a window, in dB; one very low value for a clip shorter than a window."""
    n = int(WINDOW_S * rate)
    if len(x) < n:
        return np.array([-120.0])
    power = np.convolve(np.square(x, dtype=np.float64), np.full(n, 1 / n), "valid")
    return 10 * np.log10(np.maximum(power[: len(x) - n : int(STEP_S * rate)], 0) + 1e-12)


def speech_profile(x: np.ndarray, rate: int) -> tuple[float, float, list[tuple[float, float]]]:
    """Speech level, background level, and the pauses (start, end): runs of quiet steps of at least LEAST_PAUSE_S.

    The background is the 10th percentile of what lies inside pauses between words, digital silence aside.
    """
    db = levels_db(x, rate)
    if not len(db):
        return -120.0, -120.0, []
    speech, floor = float(np.percentile(db, 95)), float(np.percentile(db, 5))
    quiet = db < max(floor + 10, speech - 38)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(int), [0]])))
    runs = [(a, b) for a, b in edges.reshape(-1, 2) if (b - a) * STEP_S >= LEAST_PAUSE_S - 1e-9]
    loud = np.flatnonzero(~quiet)
    first, last = (loud[0], loud[-1]) if len(loud) else (0, len(db))
    inner = [db[a:b] for a, b in runs if a > first and b < last]
    pool = np.concatenate(inner) if inner else db
    pool = pool[pool > -100]
    return speech, float(np.percentile(pool, 10)) if len(pool) else floor, [(a * STEP_S, b * STEP_S) for a, b in runs]


def quietest_point(x: np.ndarray, rate: int, start: float, end: float) -> float:
    """The middle of the quietest 10 ms between two times; the middle of the span if it is shorter than 20 ms."""
    lo, hi, n = max(0, int(start * rate)), min(len(x), int(end * rate)), int(0.01 * rate)
    if hi - lo < 2 * n:
        return (start + end) / 2
    energy = np.convolve(np.square(x[lo:hi], dtype=np.float64), np.ones(n), "valid")
    return (lo + int(np.argmin(energy)) + n // 2) / rate


def pitch(x: np.ndarray, rate: int) -> np.ndarray:
    """Pitch of every 10 ms by autocorrelation at PITCH_RATE; NaN where unvoiced."""
    y = resampled(x, rate, PITCH_RATE)
    n, hop = PITCH_RATE // 25, PITCH_RATE // 100
    if len(y) < n:
        return np.full(1, np.nan)
    frames = np.lib.stride_tricks.sliding_window_view(y, n)[: len(y) - n : hop] * np.hanning(n)
    if not len(frames):
        return np.full(1, np.nan)
    own = np.fft.irfft(np.abs(np.fft.rfft(frames, 2 * n)) ** 2)[:, :n]
    own = own / (own[:, :1] + 1e-12)
    low, high = PITCH_RATE // PITCH_HIGH, PITCH_RATE // PITCH_LOW
    lag = low + own[:, low:high].argmax(axis=1)
    voiced = (own[np.arange(len(lag)), lag] >= PITCH_STRENGTH) & (np.sqrt(np.mean(frames**2, axis=1)) > 1e-3)
    return np.where(voiced, PITCH_RATE / lag, np.nan)


def semitones(f0: np.ndarray) -> float | None:
    """Range of a voice: semitones between the 10th and 90th percentile of its pitch; None for under ten voiced steps."""
    v = f0[~np.isnan(f0)]
    return float(12 * np.log2(np.percentile(v, 90) / np.percentile(v, 10))) if len(v) >= 10 else None


def octave_levels(x: np.ndarray, rate: int) -> np.ndarray:
    """Levels of the octave bands in dB, over the frames of a clip that are voiced (all of them if none is)."""
    whole = max(1, len(x) // BAND_FRAME)
    frames = np.resize(np.pad(np.asarray(x, dtype=np.float64), (0, BAND_FRAME)), (whole, BAND_FRAME)) if len(x) >= BAND_FRAME else np.pad(x, (0, BAND_FRAME - len(x)))[None, :]
    loudness = 10 * np.log10(np.square(frames).mean(axis=1) + 1e-24)
    heard = loudness > max(VOICED_DB, loudness.max() - 40.0)
    spectrum = np.square(np.abs(np.fft.rfft(frames[heard if heard.any() else slice(None)] * np.hanning(BAND_FRAME)))).mean(axis=0)
    octave = np.round(np.log2(np.maximum(np.fft.rfftfreq(BAND_FRAME, 1.0 / rate), 1e-9) / OCTAVES[0]) + 1e-12).astype(int)
    energy = np.array([spectrum[octave == k].sum() for k in range(len(OCTAVES))])
    present = np.array([(octave == k).any() for k in range(len(OCTAVES))])
    return np.where(present, 10 * np.log10(energy + 1e-18), -180.0)


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples at another rate by linear interpolation."""
    if rate == target or not len(x):
        return np.asarray(x, dtype=np.float64)
    n = max(1, round(len(x) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(x)), x)


def stretched(x: np.ndarray, speed: float) -> np.ndarray:
    """Samples played at another speed by linear interpolation; speeds that make no sense leave them alone."""
    if not len(x) or not speed > 0 or speed == 1.0:
        return np.asarray(x, dtype=np.float64)
    n = max(1, round(len(x) / speed))
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)


_PROFILE = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("speech_db", "noise_db", "semitones", "voiced_share")] + [T.StructField("pauses", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])))]
)


def clip_profile(samples: str, rate: Column) -> Column:
    """struct<speech_db, noise_db, semitones, voiced_share, pauses> of each clip."""

    @F.pandas_udf(_PROFILE)
    def profile(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for clips, rates in parts:
            rows = []
            for x, r in zip(clips, rates):
                if x is None or not len(x):
                    rows.append((None, None, None, None, None))
                    continue
                x = np.asarray(x, dtype=np.float64)
                speech, noise, pauses = speech_profile(x, int(r))
                f0 = pitch(x, int(r))
                rows.append((speech, noise, semitones(f0), float(np.mean(~np.isnan(f0))), pauses))
            yield pd.DataFrame(rows, columns=_PROFILE.fieldNames())

    return profile(samples, rate)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _octaves(clips: pd.Series, rates: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or not len(x) else octave_levels(np.asarray(x, dtype=np.float64), int(r)).tolist() for x, r in zip(clips, rates)])


def band_corrections(clips: DataFrame, speaker: str, samples: str, rate: Column, strength: float = 0.5, most: float = 6.0) -> DataFrame:
    """(speaker, band_hz, level_db, correction_db): per speaker the mean octave levels around their own mean, and how far each band is
    moved toward the mean of all speakers, which is smoothed over neighbouring bands (the ends repeated); scaled and clamped."""
    levels = clips.select(F.col(speaker).alias("speaker"), _octaves(samples, rate).alias("l")).where("l is not null")
    each = levels.select("speaker", F.posexplode("l").alias("band", "db")).groupBy("speaker", "band").agg(F.avg("db").alias("db"))
    own = each.withColumn("shape", F.col("db") - F.avg("db").over(Window.partitionBy("speaker")))
    w = Window.partitionBy("speaker").orderBy("band")
    raw = own.withColumn("target", F.avg("shape").over(Window.partitionBy("band")))
    raw = raw.withColumn("smooth", (F.coalesce(F.lag("target").over(w), F.col("target")) + F.col("target") + F.coalesce(F.lead("target").over(w), F.col("target"))) / 3)
    gain = F.greatest(F.lit(-most), F.least(F.lit(most), (F.col("smooth") - F.col("shape")) * strength))
    return raw.select("speaker", F.element_at(F.array(*map(F.lit, OCTAVES)), F.col("band") + 1).alias("band_hz"), F.round("db", 3).alias("level_db"), F.round(gain, 3).alias("correction_db"))


def mixed(placements: DataFrame, recording: str, rate: int) -> DataFrame:
    """placements(recording, start_s, gain_db, samples) -> (recording, samples): the clips added at their times, scaled down if the peak is over PEAK."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        clips = [(max(0, round(s * rate)), np.asarray(x, dtype=np.float64) * 10 ** ((g or 0.0) / 20)) for s, g, x in zip(part["start_s"], part["gain_db"], part["samples"]) if x is not None]
        out = np.zeros(max((a + len(x) for a, x in clips), default=0))
        for a, x in clips:
            out[a : a + len(x)] += x
        peak = np.abs(out).max(initial=0.0)
        return pd.DataFrame({recording: [part[recording].iloc[0]], "samples": [(out * PEAK / peak if peak > PEAK else out).astype(np.float32)]})

    kind = dict(placements.dtypes)[recording]
    return placements.select(recording, "start_s", "gain_db", "samples").groupBy(recording).applyInPandas(add, f"{recording} {kind}, samples array<float>")


def breath_places(placed: DataFrame, keys: list[str], chance: Column, seed: int = 7) -> DataFrame:
    """placed(keys, turn_no, start_s, end_s, transition) -> where a speaker breathes before a turn: it moves on, is long enough, has room
    after everything before it, and a hash of the turn falls under the chance."""
    w = Window.partitionBy(*keys).orderBy("start_s", "turn_no").rowsBetween(Window.unboundedPreceding, -1)
    p = placed.withColumn("room_s", F.col("start_s") - F.coalesce(F.max("end_s").over(w), F.lit(0.0)))
    roll = F.crc32(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("turn_no").cast("string"))) / F.lit(2.0**32)
    long = (F.col("transition") != "backchannel") & (F.col("end_s") - F.col("start_s") >= BREATH_LINE_S) & (F.col("room_s") >= BREATH_GAP_S)
    return p.where(long & (roll < chance)).select(*keys, "turn_no", F.round("room_s", 3).alias("room_s"))
