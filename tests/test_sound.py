"""Speech signals on made-up tones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import sound as D

RATE = 16000


def tone(hz, seconds, level=0.3):
    return level * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)


def test_pauses_and_cuts():
    rng = np.random.default_rng(1)
    noise = lambda s: 0.0005 * rng.standard_normal(int(RATE * s))
    x = np.concatenate([tone(200, 0.6), noise(0.4), tone(200, 0.5), noise(0.05), tone(200, 0.5)])
    speech, background, pauses = D.speech_profile(x, RATE)
    assert len(pauses) == 1 and pauses[0][0] == pytest.approx(0.6, abs=0.03) and pauses[0][1] == pytest.approx(1.0, abs=0.03)
    assert speech == pytest.approx(20 * np.log10(0.3 / np.sqrt(2)), abs=0.5) and background == pytest.approx(-66, abs=2)
    assert 0.6 < D.quietest_point(x, RATE, 0.5, 0.9) < 0.91 and D.quietest_point(x, RATE, 0.1, 0.11) == pytest.approx(0.105)
    assert D.levels_db(x[:10], RATE).tolist() == [-120.0] and D.speech_profile(np.zeros(0), RATE)[2] == []


def test_pitch_and_bands():
    f0 = D.pitch(tone(220, 0.5), RATE)
    assert np.nanmedian(f0) == pytest.approx(220, rel=0.03) and np.isnan(D.pitch(np.zeros(RATE), RATE)).all()
    assert D.semitones(np.r_[np.full(20, 100.0), np.full(20, 200.0)]) == pytest.approx(12) and D.semitones(np.array([100.0])) is None
    levels = D.octave_levels(tone(1000, 0.5), RATE)
    assert int(levels.argmax()) == D.OCTAVES.index(1000.0) and len(levels) == 7 and len(D.octave_levels(tone(500, 0.01), RATE)) == 7
    assert len(D.resampled(tone(100, 0.1), RATE, 8000)) == 800 and len(D.stretched(tone(100, 0.1), 2.0)) == 800 and len(D.resampled(np.zeros(0), RATE, 8000)) == 0


def test_clips_of_speakers(spark):
    rows = [("a", tone(250, 0.4).tolist()), ("a", []), ("b", tone(2000, 0.4).tolist()), ("b", None)]
    clips = spark.createDataFrame(rows, "who string, samples array<float>")
    got = {(r["speaker"], r["band_hz"]): r["correction_db"] for r in D.band_corrections(clips, "who", "samples", F.lit(RATE)).collect()}
    assert len(got) == 14 and got["a", 250.0] < 0 < got["a", 4000.0] and max(map(abs, got.values())) <= 6.0
    profiles = clips.select("who", D.clip_profile("samples", F.lit(RATE)).alias("p")).collect()
    assert sum(r["p"]["speech_db"] is not None for r in profiles) == 2


def test_mix_and_breaths(spark):
    placed = spark.createDataFrame([("r", 0.0, 0.0, [0.5, 0.5]), ("r", 0.0001, 0.0, [0.9]), ("r", 0.0002, None, None), ("q", 0.0, -6.0, [1.0])], "rec string, start_s double, gain_db double, samples array<float>")
    got = {r["rec"]: r["samples"] for r in D.mixed(placed, "rec", 10000).collect()}
    assert got["r"] == pytest.approx([0.5 * 0.98 / 1.4, 0.98]) and got["q"] == pytest.approx([10 ** (-6 / 20)])
    turns = spark.createDataFrame([("e", 1, 0.0, 5.0, "first"), ("e", 2, 5.3, 9.0, "plain"), ("e", 3, 6.0, 9.5, "backchannel"), ("e", 4, 9.6, 13.0, "plain"), ("e", 5, 13.4, 14.0, "plain")], "e string, turn_no int, start_s double, end_s double, transition string")
    assert [(r["turn_no"], r["room_s"]) for r in D.breath_places(turns, ["e"], F.lit(1.0)).collect()] == [(2, 0.3)]
    assert D.breath_places(turns, ["e"], F.lit(0.0)).count() == 0
