"""Review operators on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import review as R


def test_takes_and_turns(spark):
    turns = spark.createDataFrame([("e", 1, "t", "ok", 0.1, False, False), ("e", 2, "t", "reaction bank", None, False, False), ("e", 3, "t", "x", None, None, True), ("e", 4, None, None, 0.0, True, None)], "e string, turn int, take string, reason string, wer double, flagged boolean, fallback boolean")
    assert {r["turn"] for r in R.suspect_turns(turns).collect()} == {2, 3, 4}
    assert tuple(R.verification_coverage(turns, ["e"]).first()) == ("e", 1, 2, 1)
    levels = spark.createDataFrame([("a", "ok"), ("a", "bad"), ("b", "warn"), ("c", None)], "clip string, level string")
    assert {r["clip"]: r["verdict"] for r in R.clip_verdicts(levels, "clip").collect()} == {"a": "bad", "b": "warn", "c": "ok"}


def test_reviewed_claims(spark):
    frame = lambda rows: spark.createDataFrame([("c", i, p) for i, p in rows], "ch string, claim_id string, place int")
    got = R.reviewed_claims(frame([("a", 1), ("b", 2), ("d", 3)]), frame([("b", 0)]), frame([("x", 1), ("a", 2), ("none", 3), ("y", 4), ("x", 5)]), frame([("a", 0), ("b", 0), ("d", 0), ("x", 0), ("y", 0)]), ["ch"], 3)
    assert [r["claim_id"] for r in got.orderBy("place").collect()] == ["a", "d", "x"]


def test_approval_and_resume(spark):
    lines = spark.createDataFrame([("b", "e", 1), ("b", "e", 2)], "book_id string, episode_id string, revision int")
    verdicts = spark.createDataFrame([("b", "e", 1, True), ("b", "e", 2, False)], "book_id string, episode_id string, revision int, passed boolean")
    asked = spark.createDataFrame([("b", "e", 1, True), ("b", "e", 2, False), ("b", "e", 2, True), ("x", "e", 1, True)], "book_id string, episode_id string, revision int, forced boolean")
    assert sorted((r["book_id"], r["revision"], r["approved"]) for r in R.approvals(lines, verdicts, asked).collect()) == [("b", 1, False), ("b", 2, False), ("b", 2, True), ("x", 1, False)]
    times = spark.createDataFrame([("b", "1", 1, 2, 1, 3, 4, 2, 2, True), ("b", "2", 5, 2, 9, 3, 4, 2, 2, True), ("b", "3", 1, 2, None, 2, None, 2, 1, True), ("b", "4", 1, None, None, None, None, None, None, None)], "book_id string, chapter_id string, book_t int, plan_t int, glossary_t int, script_t int, audio_t int, script_revision int, audit_revision int, approved boolean")
    assert {r["chapter_id"]: r["done"] for r in R.resumable(times).collect()} == {"1": ["plan", "glossary", "script", "approve", "render"], "2": [], "3": ["plan", "script", "audit_stale"], "4": []}


def test_pages(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    lines = spark.createDataFrame([(1, 0, "Figuur 1. Dijk", (0.0, 110.0, 50.0, 120.0)), (1, 1, "Tabel 2 Zand", (0.0, 105.0, 9.0, 108.0)), (1, 2, "Figuur 2", (0.0, 200.0, 9.0, 210.0)), (1, 3, "tekst", (0.0, 101.0, 9.0, 102.0))], f"page int, line_no int, text string, bbox {box}")
    boxes = spark.createDataFrame([(1, 0, "figure", (0.0, 0.0, 100.0, 100.0)), (1, 1, "table", (0.0, 500.0, 9.0, 600.0))], f"page int, box_no int, kind string, bbox {box}")
    assert [(r["box_no"], r["line_no"]) for r in R.nearest_captions(lines, boxes).collect()] == [(0, 0)]
    row = spark.range(1).select(
        R.is_label_only(F.lit("Willem van Oranje  Karel de Vijfde")).alias("names"), R.is_label_only(F.lit("Een dijk van klei en zand")).alias("said"), R.is_bold(F.lit(16), F.lit(None).cast("string")).alias("b1"), R.is_bold(F.lit(0), F.lit("Arial-Black")).alias("b2"), R.is_bold(F.lit(0), F.lit("Arial")).alias("b3"),
        R.without_footnote_marks(F.lit("Wilhelmus’* en 3*4†")).alias("marks"), R.figure_text(F.lit(" Een dijk. ")).alias("figure"), R.figure_text(F.lit(None).cast("string")).alias("none"), R.in_range(F.lit(0.12345), 0, 1).alias("ok"), R.in_range(F.lit(2.0), 0, 1).alias("out"),
        R.bank_pick(F.array(F.lit("b"), F.lit("a")), F.lit(0.99)).alias("clip"), R.crc_roll(F.lit("7"), F.lit("t1")).alias("roll"), R.run_id(F.lit(datetime.datetime(2024, 1, 2, 3, 4, 5, 6))).alias("id"),
    ).first()
    assert (row["names"], row["said"], row["b1"], row["b2"], row["b3"]) == (True, False, True, True, False)
    assert (row["marks"], row["figure"], row["none"], row["ok"], row["out"], row["clip"], row["id"]) == ("Wilhelmus’ en 3*4†", "[Een dijk.]", "", 0.123, None, "b", "20240102T030405000006")
    assert 0 <= row["roll"] < 1


def test_word_times(spark):
    heard = [("de", 0.1, 0.2), ("dyk", 0.3, 0.6), ("het", 1.5, 1.6), ("water", 1.7, 2.0)]
    got = R.word_times("De dijk houdt stevig het water.".split(), heard, 3.0)
    assert [w for w, _, _ in got] == "De dijk houdt stevig het water.".split() and got[0][1:] == (0.1, 0.2) and got[5][1:] == (1.7, 2.0)
    assert 0.2 <= got[2][1] < got[2][2] <= got[3][1] < got[3][2] <= 1.5
    assert R.word_times([], heard, 1.0) == [] and R.word_times(["a", "b"], [], 1.0)[1] == ("b", 0.5, pytest.approx(0.95))
    df = spark.createDataFrame([("de dijk", [("de", 0.0, 0.5)], 2.0), (None, None, None)], "text string, heard array<struct<word: string, start_s: double, end_s: double>>, duration_s double")
    assert [len(r["words"]) for r in R.aligned(df).collect()] == [2, 0]
