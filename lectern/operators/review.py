"""Small operators around review: takes and turns, approval and resume, previews, captions, word times from a recogniser."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.script import EPISODE
from lectern.operators.structure import CAPTION

# Particles of names, marks of footnotes, words of table captions, and bounds.
NAME_PARTICLES = ["van", "de", "der", "den", "het", "ten", "ter", "te", "von", "la", "le", "du", "and", "en"]
FOOTNOTE_MARK = "(?<=[\\p{L}’'”»])[*†‡]+"
TABLE_CAPTION = "(?i)^(tabel|table|tabelle)"
CAPTION_DISTANCE, BOX_TOLERANCE, PREVIEW_LINES, PREVIEW_CHARS, MOST_CLAIMS = 60.0, 2.0, 3, 220, 25


def is_bold(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | F.coalesce(F.lower(font).rlike("bold|black|heavy"), F.lit(False))


def is_label_only(text: Column) -> Column:
    """Names under a picture: fewer than four words, or nothing but capitalised words and particles."""
    words = F.regexp_extract_all(text, F.lit("(\\p{L}[\\p{L}\\p{N}_'’-]*)"), F.lit(1))
    return (F.size(words) < 4) | F.forall(words, lambda w: w.rlike("^\\p{Lu}") | F.lower(w).isin(*NAME_PARTICLES))


def box_inside(inner: Column, outer: Column, tolerance: float = BOX_TOLERANCE) -> Column:
    """Whether a box (struct<x0, y0, x1, y1>) lies in another."""
    return (inner["x0"] >= outer["x0"] - tolerance) & (inner["y0"] >= outer["y0"] - tolerance) & (inner["x1"] <= outer["x1"] + tolerance) & (inner["y1"] <= outer["y1"] + tolerance)


def without_footnote_marks(text: Column) -> Column:
    return F.regexp_replace(text, FOOTNOTE_MARK, "")


def figure_text(caption: Column) -> Column:
    """A figure as its caption in brackets; without a caption nothing is heard."""
    bare = F.rtrim(F.trim(F.coalesce(caption, F.lit(""))), F.lit("."))
    return F.when(bare == "", "").otherwise(F.concat(F.lit("["), bare, F.lit(".]")))


def nearest_captions(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """lines(page, line_no, text, bbox), boxes(page, box_no, kind, bbox) -> (page, box_no, line_no, text): the caption of a box's kind nearest above or below it, the first on a tie."""
    shown = lines.where(F.trim("text").rlike(CAPTION)).select("page", "line_no", "text", F.col("bbox").alias("at"), F.when(F.trim("text").rlike(TABLE_CAPTION), "table").otherwise("figure").alias("kind"))
    apart = F.least(F.abs(F.col("at.y0") - F.col("bbox.y1")), F.abs(F.col("bbox.y0") - F.col("at.y1")))
    near = boxes.join(shown, ["page", "kind"]).withColumn("apart", apart).where(F.col("apart") < CAPTION_DISTANCE)
    return near.groupBy("page", "box_no").agg(F.min_by(F.struct("line_no", "text"), F.struct("apart", "line_no")).alias("c")).select("page", "box_no", "c.line_no", "c.text")


def suspect_turns(turns: DataFrame) -> DataFrame:
    """turns(..., flagged, fallback, wer) that need an ear: flagged, with estimated word times, or without a check."""
    return turns.where(F.coalesce("flagged", F.lit(False)) | F.coalesce("fallback", F.lit(False)) | F.col("wer").isNull())


def verification_coverage(turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verified, total, estimated): turns with a take that isn't from the reaction bank, those of them with an error rate, and turns with estimated times."""
    counted = F.col("take").isNotNull() & ~F.coalesce(F.col("reason") == "reaction bank", F.lit(False))
    return turns.groupBy(*keys).agg(F.count_if(counted & F.col("wer").isNotNull()).alias("verified"), F.count_if(counted).alias("total"), F.count_if(F.coalesce("fallback", F.lit(False))).alias("estimated"))


def clip_verdicts(findings: DataFrame, key: str) -> DataFrame:
    """(key, verdict): the worst level of a clip's findings(key, level): bad, warn or ok."""
    rank = F.max(F.when(F.col("level") == "bad", 2).when(F.col("level") == "warn", 1).otherwise(0))
    return findings.groupBy(key).agg(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("bad")), (rank + 1).cast("int")).alias("verdict"))


def reviewed_claims(selected: DataFrame, remove: DataFrame, add: DataFrame, pool: DataFrame, keys: list[str], most: int = MOST_CLAIMS) -> DataFrame:
    """(keys, claim_id, place): selected(keys, claim_id, place) without what a review takes out, then what it adds (place: its order) if
    it is in the pool and not there yet; at most ``most`` a chapter, which is the feature."""
    stay = selected.join(remove.select(*keys, "claim_id").distinct(), [*keys, "claim_id"], "left_anti").select(*keys, "claim_id", F.struct(F.lit(0).alias("new"), F.col("place").cast("long").alias("at")).alias("order"))
    fresh = add.join(pool.select(*keys, "claim_id").distinct(), [*keys, "claim_id"], "left_semi").join(selected.select(*keys, "claim_id"), [*keys, "claim_id"], "left_anti")
    both = stay.unionByName(fresh.select(*keys, "claim_id", F.struct(F.lit(1).alias("new"), F.col("place").cast("long").alias("at")).alias("order"))).groupBy(*keys, "claim_id").agg(F.min("order").alias("order"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("order", "claim_id"))
    return both.withColumn("place", place).where(F.col("place") <= most).select(*keys, "claim_id", "place")


def approvals(lines: DataFrame, verdicts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(book_id, episode_id, revision, forced) with approved: the revision is the script's latest and passed its audit, or was forced."""
    latest = lines.groupBy("book_id", "episode_id").agg(F.max("revision").alias("latest"))
    passed = verdicts.select(*EPISODE, "passed")
    out = asked.join(latest, ["book_id", "episode_id"], "left").join(passed, EPISODE, "left")
    good = (F.col("revision") == F.col("latest")) & (F.coalesce("passed", F.lit(True)) | F.coalesce("forced", F.lit(False)))
    return out.select(*EPISODE, F.coalesce(good, F.lit(False)).alias("approved"))


def resumable(times: DataFrame) -> DataFrame:
    """times(book_id, chapter_id, book_t, plan_t, glossary_t, script_t, audio_t, script_revision, audit_revision, approved) with done: the
    stages that needn't run again. A stage counts only if its artifact is as new as what it was made from and all before it count."""
    no = F.lit(False)
    plan = F.coalesce(F.col("plan_t") >= F.col("book_t"), no)
    glossary = plan & F.coalesce(F.col("glossary_t") >= F.col("book_t"), no)
    script = plan & F.coalesce(F.col("script_t") >= F.col("plan_t"), no)
    fresh = script & F.coalesce(F.col("script_revision") == F.col("audit_revision"), no)
    approve = fresh & F.coalesce(F.col("approved"), no)
    render = approve & F.coalesce(F.col("audio_t") >= F.col("script_t"), no)
    stages = {"plan": plan, "glossary": glossary, "script": script, "audit_stale": script & ~fresh, "approve": approve, "render": render}
    return times.select("book_id", "chapter_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in stages.items()])).alias("done"))


def previews(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """(episode, seg_no, place, speaker_name, preview): the first lines of each segment, cut where they are long (a top-k report)."""
    nth = F.row_number().over(Window.partitionBy(*EPISODE, "seg_no").orderBy("pos", "line_id"))
    names = speakers.select(F.lower("id").alias("speaker"), F.col("name").alias("speaker_name")).dropDuplicates(["speaker"])
    first = lines.withColumn("place", nth).where(F.col("place") <= PREVIEW_LINES).join(names, "speaker", "left")
    cut = F.when(F.length("text") > PREVIEW_CHARS, F.concat(F.substring("text", 1, PREVIEW_CHARS - 3), F.lit("..."))).otherwise(F.col("text"))
    return first.select(*EPISODE, "seg_no", "place", F.coalesce("speaker_name", "speaker").alias("speaker_name"), cut.alias("preview"))


def run_id(at: Column) -> Column:
    """A run's identifier: a UTC stamp that sorts as a string."""
    return F.date_format(at, "yyyyMMdd'T'HHmmssSSSSSS")


def in_range(value: Column, low: float, high: float) -> Column:
    """A parameter with three decimals, null outside its range."""
    return F.when(value.between(low, high), F.bround(value, 3))


def crc_roll(*parts: Column) -> Column:
    """A number in [0, 1) from the parts' checksum."""
    return F.crc32(F.concat_ws(":", *parts)) / F.lit(2.0**32)


def bank_pick(clips: Column, fraction: Column) -> Column:
    """The clip of a sorted bank that a fraction in [0, 1) chooses; null from an empty bank."""
    ordered = F.array_sort(clips)
    return F.get(ordered, F.floor(fraction * F.size(ordered)).cast("int"))


_TIMED = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))
_PUNCTUATION = re.compile("[^\\w]")
LEAST_WORD_S, VOICED, SLACK_S = 0.05, 0.9, 0.05


def word_times(tokens: list[str], heard: list[tuple[str, float, float]], duration: float) -> list[tuple[str, float, float]]:
    """Times of a script's words from a recogniser's: equal words, and replaced ones that are as many, take what was heard; times that run
    backwards are dropped; the words between two anchors share the gap by their lengths."""
    if not tokens:
        return []
    plain = lambda words: [_PUNCTUATION.sub("", w.casefold()) for w in words]
    anchors: dict[int, tuple[float, float]] = {}
    reached = -1.0
    for kind, i, i_end, j, j_end in difflib.SequenceMatcher(None, plain(tokens), plain([w for w, _, _ in heard]), autojunk=False).get_opcodes():
        if kind == "equal" or kind == "replace" and i_end - i == j_end - j:
            for k, (_, a, b) in zip(range(i, i_end), heard[j:j_end]):
                if a >= reached - SLACK_S:
                    anchors[k], reached = (a, b), b
    known = [-1, *sorted(anchors), len(tokens)]
    times = dict(anchors)
    for before, after in zip(known, known[1:]):
        gap = range(before + 1, after)
        if not gap:
            continue
        start = anchors[before][1] if before >= 0 else heard[0][1] if heard else 0.0
        end = anchors[after][0] if after < len(tokens) else min(duration, heard[-1][2]) if heard else duration
        end = max(end, start + LEAST_WORD_S * len(gap))
        share = (end - start) / sum(len(tokens[k]) + 1 for k in gap)
        for k in gap:
            width = share * (len(tokens[k]) + 1)
            times[k] = (start, start + VOICED * width)
            start += width
    return [(t, *times[k]) for k, t in enumerate(tokens)]


def aligned(turns: DataFrame) -> DataFrame:
    """turns(text, heard: array<struct<word, start_s, end_s>>, duration_s, ...) with words: the text's words with their times."""

    @F.pandas_udf(_TIMED)
    def words(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, heards, lengths in parts:
            yield pd.Series([word_times(t.split() if isinstance(t, str) else [], [(h["word"], h["start_s"], h["end_s"]) for h in (heard if heard is not None else [])], float(n or 0.0)) for t, heard, n in zip(texts, heards, lengths)])

    return turns.withColumn("words", words("text", "heard", "duration_s"))
