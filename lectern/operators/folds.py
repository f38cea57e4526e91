"""Order-dependent operators, in parallel over episodes or chapters.

Where an order-dependent result is a sum of steps between neighbours (the timeline), it is a window; where each place determines
its successor (blocks), successors are found for all places at once and then followed; only recurrences with rounding in every
step and greedy comparisons run row by row, one group of an episode or chapter loaded at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X
from lectern.operators.matching import indel_ratio
from lectern.operators.script import EPISODE, turn_numbers

# How much a stage tag lifts the voice, and the share of mood that is carried on.
TAG_LIFT = {"excited": 0.20, "laughs": 0.25, "laughing": 0.25, "deadpan": -0.20, "skeptical": -0.10, "thinking": -0.10, "sighs": -0.05, "serious": -0.10, "warm": 0.05, "annoyed": 0.10, "surprised": 0.20, "whisper": -0.25, "fast": 0.10, "slow": -0.10, "question": 0.05}
CARRY, CROSS_CARRY, LEAST_LIFT, MOST_LIFT = 0.6, 0.2, 0.15, 0.95
# Gaps between turns in seconds, and how overlaps are placed, lowered and faded.
GAP, SEGMENT_GAP, QUICK_GAP, FRAGMENT = (0.18, 0.42), (0.6, 0.9), (-0.06, 0.09), (0.4, 0.6)
QUICK_WORDS, INTERRUPT_LEAD, BACKCHANNEL_POINT, LAUGH_POINT, CUT_SHARE = 6, 0.25, 0.6, 0.5, 0.85
INTERRUPT_DUCK_DB, QUICK_DUCK_DB, FRAGMENT_FADE, UNWRITTEN_SLACK = 12.0, 4.0, 0.12, 0.45
BLOCK_CHARS, SEGMENT_FILL, TURN_FILL = 3000, 0.4, 0.5
REPEAT_CHARS, REPEAT_RATIO, REPEAT_LENGTH, GRAM_BUCKETS = 60, 88.0, 0.3, 256


def lifted(tags: Column, base: Column) -> Column:
    """Base plus the lifts of the tags, clamped."""
    lift = F.create_map(*[F.lit(x) for kv in TAG_LIFT.items() for x in kv])
    total = F.aggregate(tags, base.cast("double"), lambda a, t: a + F.coalesce(F.element_at(lift, t), F.lit(0.0)))
    return F.greatest(F.lit(LEAST_LIFT), F.least(F.lit(MOST_LIFT), total))


def emotion_carry(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """Each line's exaggeration: the speaker's own mood carried on, mixed with the previous speaker's; three decimals."""
    base = speakers.select(F.lower("id").alias("speaker"), F.coalesce("exaggeration", F.lit(0.5)).alias("base")).dropDuplicates(["speaker"])
    rows = lines.join(base, "speaker", "left").select(*EPISODE, "pos", "line_id", "speaker", lifted(F.col("tags"), F.coalesce("base", F.lit(0.5))).alias("target"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        state: dict[str, float] = {}
        before, last, out = None, 0.0, []
        part = part.sort_values(["pos", "line_id"])
        for speaker, target in zip(part["speaker"], part["target"]):
            value = CARRY * state.get(speaker, target) + (1 - CARRY) * target
            if before is not None and before != speaker:
                value = (1 - CROSS_CARRY) * value + CROSS_CARRY * last
            value = round(value, 3)
            state[speaker], before, last = value, speaker, value
            out.append(value)
        return part.assign(exaggeration=out)[[*EPISODE, "line_id", "exaggeration"]]

    return rows.groupBy(*EPISODE).applyInPandas(fold, "book_id string, episode_id string, revision int, line_id string, exaggeration double")


def block_starts(sizes: np.ndarray, new_segment: np.ndarray, new_speaker: np.ndarray, most: int) -> list[int]:
    """First lines of the blocks of one episode.

    Where a block begins determines where the next begins: at the first change of segment that stands behind SEGMENT_FILL of the
    limit, if one comes no later than the first line that is too much; else at the last change of speaker before that line, if
    TURN_FILL stands before it; else at that line. All three are searches in the cumulative sizes and the places of changes.
    """
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    segments, speakers = np.flatnonzero(new_segment), np.flatnonzero(new_speaker)
    first = np.arange(n)
    over = np.maximum(np.searchsorted(upto, upto[:-1] + most, side="right") - 1, first + 1)  # the line that is too much; n if none is
    filled = np.maximum(np.searchsorted(upto, upto[:-1] + SEGMENT_FILL * most, side="left"), first + 1)
    at = np.searchsorted(segments, filled)
    by_segment = np.append(segments, n)[at]
    at = np.searchsorted(speakers, over, side="left") - 1
    by_speaker = np.where(at >= 0, np.append(speakers, -1)[at], -1)
    half = (by_speaker > first) & (upto[np.maximum(by_speaker, 0)] - upto[:-1] >= TURN_FILL * most)
    after = np.where(by_segment <= np.minimum(over, n - 1), by_segment, np.where(half & (over < n), by_speaker, over))
    starts = []
    i = 0
    while i < n:
        starts.append(i)
        i = int(after[i])
    return starts


def script_blocks(lines: DataFrame, most: int = BLOCK_CHARS) -> DataFrame:
    """Lines in blocks of at most ``most`` characters, see block_starts; a longer line is a block of its own."""
    w = Window.partitionBy(*EPISODE).orderBy("pos", "line_id")
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = lines.select(*EPISODE, "pos", "line_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), changed("seg_no").alias("new_segment"), changed("speaker").alias("new_speaker"))

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["pos", "line_id"])
        starts = block_starts(part["n"].to_numpy(np.int64), part["new_segment"].to_numpy(bool), part["new_speaker"].to_numpy(bool), most)
        blocks = np.zeros(len(part), dtype=np.int32)
        blocks[starts] = 1
        return part.assign(block_no=np.cumsum(blocks))[[*EPISODE, "line_id", "block_no"]]

    return rows.groupBy(*EPISODE).applyInPandas(number, "book_id string, episode_id string, revision int, line_id string, block_no int")


def _advancing(turns: DataFrame) -> DataFrame:
    """turns with target_no (the turn their overlap names), lies_inside (an accepted backchannel) and last_no (the last turn before that moves on).

    A backchannel is accepted if its target is the last turn before it that moves on. A stretch of backchannels on one turn right
    after that turn is linked to it; linked stretches that follow one another alternate, since an accepted backchannel can't be a target.
    """
    w = Window.partitionBy(*EPISODE).orderBy("turn_no")
    owner = turns.select(*EPISODE, F.explode("line_ids").alias("target"), F.col("turn_no").alias("target_no"), F.col("speaker").alias("target_speaker"))
    named = turns.join(owner, [*EPISODE, "target"], "left").withColumn("meets", F.coalesce((F.col("target_no") < F.col("turn_no")) & (F.col("target_speaker") != F.col("speaker")), F.lit(False)))
    asks = named.withColumn("asks", (F.col("mode") == "backchannel") & F.col("meets"))
    same = F.col("asks") & F.coalesce(F.lag("asks").over(w), F.lit(False)) & F.col("target_no").eqNullSafe(F.lag("target_no").over(w))
    islands = asks.withColumn("before_no", F.lag("turn_no").over(w)).withColumn("island", F.sum((~same).cast("int")).over(w))
    first = Window.partitionBy(*EPISODE, "island").orderBy("turn_no")
    linked = F.col("asks") & F.col("target_no").eqNullSafe(F.first("before_no").over(first))
    chain = islands.withColumn("linked", linked).withColumn("base", F.last(F.when(~F.col("linked"), F.col("island")), ignorenulls=True).over(w))
    inside = F.col("linked") & ((F.col("island") - F.col("base")) % 2 == 1)
    out = chain.withColumn("lies_inside", F.coalesce(inside, F.lit(False)))
    return out.withColumn("last_no", F.last(F.when(~F.col("lies_inside"), F.col("turn_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).drop("asks", "before_no", "island", "linked", "base", "target_speaker")


def timeline(turns: DataFrame) -> DataFrame:
    """turns(episode, turn_no, speaker, seg_no, mode, target, cut_word, line_ids, tags, reaction, text, pause_s, duration_s, timing_gap_s, words) -> placements.

    words: array<struct<word, start_s>> with times from the turn's start; timing_gap_s: what a timing label asks for, or null. Of a
    placement: start_s, end_s (of the sound, or where it is faded out), transition, duck_s and duck_db (from where and how far
    the turn is lowered), cut_s, deliberate_s (written silence after it), ignored (an overlap whose target isn't the turn before).

    The start of a turn that moves on is that of the last such turn plus a step that these two determine, so starts are a running
    sum. An interruption comes before the onset of the word it cuts and cuts it; a backchannel lies inside the turn before, from
    the next word after 60 % of it (a laugh: half); a question or a short line is answered quickly; a timing label sets the
    gap itself. Gaps come from a hash of episode and turn within the range of the transition.
    """
    w = Window.partitionBy(*EPISODE).orderBy("turn_no")
    text = F.trim("text")
    draw = X.seeded_fraction(F.col("book_id"), F.col("episode_id"), F.col("revision").cast("string"), F.col("turn_no").cast("string"))
    quick = F.coalesce(text.endswith("?") | ((text != "") & (X.word_count(text) <= QUICK_WORDS)), F.lit(False))
    laugh = F.coalesce(F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("laughs"), F.lit("laughing"))), F.lit(False)) | F.coalesce(F.col("reaction").isin("laugh", "chuckle"), F.lit(False))
    t = _advancing(turns).withColumn("draw", draw).withColumn("quick", quick).withColumn("laugh", laugh).withColumn("words", F.coalesce("words", F.array().cast("array<struct<word:string,start_s:double>>")))
    carried = ["turn_no", "speaker", "seg_no", "pause_s", "duration_s", "quick", "words"]
    moving = F.when(~F.col("lies_inside"), F.struct(*carried))
    t = t.withColumn("last", F.last(moving, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    last = lambda c: F.col(f"last.{c}")
    cuts = (F.col("mode") == "interrupt") & F.col("meets") & F.col("target_no").eqNullSafe(F.col("last_no"))
    norm = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_]", "")
    cut_word = F.filter("last.words", lambda x: (norm(x["word"]) == norm(F.col("cut_word"))) & (norm(F.col("cut_word")) != ""))
    onset = F.coalesce(F.try_element_at(cut_word, F.lit(-1))["start_s"], F.try_element_at(last("words"), F.lit(-1))["start_s"], CUT_SHARE * last("duration_s"))
    point = F.when(F.col("laugh"), LAUGH_POINT).otherwise(BACKCHANNEL_POINT) * last("duration_s")
    inside = F.coalesce(F.array_min(F.transform(F.filter("last.words", lambda x: x["start_s"] >= point), lambda x: x["start_s"])), point)
    between = lambda bounds: F.lit(bounds[0]) + F.col("draw") * (bounds[1] - bounds[0])
    other_segment = ~F.col("seg_no").eqNullSafe(last("seg_no"))
    quickly = last("quick") & (last("pause_s") == 0) & (last("speaker") != F.col("speaker"))
    kind = F.when(F.col("last").isNull(), "first").when(F.col("lies_inside"), "backchannel").when(cuts, "interrupt").when(other_segment, "segment").when(F.col("timing_gap_s").isNotNull(), "timed").when(quickly, "quick").otherwise("plain")
    t = t.withColumn("transition", kind).withColumn("onset", onset)
    gap = F.when(F.col("transition") == "segment", between(SEGMENT_GAP)).when(F.col("transition") == "timed", F.col("timing_gap_s")).when(F.col("transition") == "quick", between(QUICK_GAP)).otherwise(between(GAP))
    t = t.withColumn("gap", gap)
    step = F.when(F.col("last").isNull(), 0.0).when(F.col("transition") == "interrupt", F.greatest(F.lit(0.1), F.col("onset") - INTERRUPT_LEAD)).otherwise(last("duration_s") + last("pause_s") + F.col("gap"))
    t = t.withColumn("moved", F.sum(F.when(F.col("lies_inside"), 0.0).otherwise(step)).over(w))
    t = t.withColumn("start", F.col("moved") + F.when(F.col("lies_inside"), inside).otherwise(0.0))
    # What the next turn that moves on does to this one.
    ahead = Window.partitionBy(*EPISODE, "lies_inside").orderBy("turn_no")
    following = F.lead(F.struct("transition", "start", "onset", "gap", "draw")).over(ahead)
    t = t.withColumn("next", F.when(~F.col("lies_inside"), following))
    cut = F.when(F.col("next.transition") == "interrupt", F.least(F.col("start") + F.col("duration_s"), F.col("start") + F.col("next.onset") + FRAGMENT[0] + F.col("next.draw") * (FRAGMENT[1] - FRAGMENT[0])))
    early = F.col("next.transition").isin("quick", "timed") & (F.col("next.gap") < 0)
    duck_db = F.when(F.col("next.transition") == "interrupt", INTERRUPT_DUCK_DB).when(early & (F.col("next.gap") + F.col("pause_s") < 0), QUICK_DUCK_DB)
    written = F.when(F.col("next.transition") == "interrupt", 0.0).when(F.col("next.transition").isin("segment", "timed"), F.col("next.gap") + F.col("pause_s")).otherwise(F.col("pause_s"))
    t = t.withColumn("cut", cut).withColumn("duck_db", duck_db)
    end = F.least(F.col("start") + F.col("duration_s"), F.coalesce(F.col("cut") + FRAGMENT_FADE, F.col("start") + F.col("duration_s")))
    ignored = (F.col("mode") != "none") & ~F.col("transition").isin("interrupt", "backchannel")
    return t.select(
        *EPISODE, "turn_no", F.round("start", 3).alias("start_s"), F.round(end, 3).alias("end_s"), "transition", F.round("cut", 3).alias("cut_s"), F.when(F.col("duck_db").isNotNull(), F.round("next.start", 3)).alias("duck_s"), "duck_db",
        F.round(F.when(~F.col("lies_inside"), F.coalesce(written, F.lit(0.0))), 3).alias("deliberate_s"), F.col("pause_s").cast("double").alias("pause_s"), ignored.alias("ignored"),
    )


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start_s", T.DoubleType())])))
def _onsets(texts: pd.Series, lengths: pd.Series) -> pd.Series:
    out = []
    for text, length in zip(texts, lengths):
        words = text.split() if isinstance(text, str) else []
        upto = np.cumsum([0, *(len(w) + 1 for w in words)])
        out.append([(w, float(length * a / upto[-1])) for w, a in zip(words, upto)])
    return pd.Series(out)


def turn_words(turns: DataFrame) -> DataFrame:
    """turns with words: estimated onsets, each word taking its letters and one more of the turn's length. Linear in the text, however long."""
    return turns.withColumn("words", _onsets("text", "duration_s"))


def script_turns(lines: DataFrame) -> DataFrame:
    """The speaker turns of ``script.turns`` with what the timeline needs; the length is what the text takes."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "line_id", "text", "tags", "mode", "target", "cut_word", "pause_after_ms", "reaction")))
    numbered = turn_numbers(lines)
    t = numbered.groupBy(*EPISODE, "turn_no").agg(F.min_by("speaker", "pos").alias("speaker"), F.min_by("seg_no", "pos").alias("seg_no"), rows.alias("rows"))
    head, tail = F.get("rows", F.lit(0)), F.try_element_at("rows", F.lit(-1))
    words = F.array_join(F.transform("rows", lambda r: F.coalesce(r["text"], F.lit(""))), " ")
    return turn_words(
        t.select(
            *EPISODE, F.col("turn_no").cast("long").alias("turn_no"), "speaker", "seg_no", head["mode"].alias("mode"), head["target"].alias("target"), head["cut_word"].alias("cut_word"), head["reaction"].alias("reaction"), head["tags"].alias("tags"),
            F.transform("rows", lambda r: r["line_id"]).alias("line_ids"), tail["text"].alias("last_text"), (tail["pause_after_ms"] / 1000).alias("pause_s"), words.alias("text"), F.greatest(F.lit(0.3), F.length(words) / 15.0).alias("duration_s"), F.lit(None).cast("double").alias("timing_gap_s"),
        )
    ).withColumn("text", F.col("last_text")).drop("last_text")


def unwritten_gaps(placed: DataFrame, most: float = 1.2) -> DataFrame:
    """Silences between turns that move on, longer than ``most`` seconds and than what is written there: the deliberate gap, the pause and UNWRITTEN_SLACK."""
    w = Window.partitionBy(*EPISODE).orderBy("turn_no")
    gap = F.lead("start_s").over(w) - F.col("end_s")
    moving = placed.where("transition <> 'backchannel'").withColumn("gap_s", F.round(gap, 3))
    return moving.where((F.col("gap_s") > most) & (F.col("gap_s") > F.col("deliberate_s") + F.col("pause_s") + UNWRITTEN_SLACK)).select(*EPISODE, "turn_no", "gap_s")


def _grams(text: str) -> np.ndarray:
    """Number of the text's three-character pieces in each of GRAM_BUCKETS buckets."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % GRAM_BUCKETS, minlength=GRAM_BUCKETS).astype(np.int32)


def _pieces(texts: list[str], size: int) -> np.ndarray:
    """Number of pieces of ``size`` characters in each of GRAM_BUCKETS buckets, a row a text; 4096 texts at a time."""
    rows = []
    for i in range(0, len(texts), 4096):
        some = texts[i : i + 4096]
        c = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(some)), list(map(len, some)))
        n = max(0, len(c) - size + 1)
        bucket = sum(c[k : k + n] * 31 ** (size - 1 - k) for k in range(size)) % GRAM_BUCKETS
        whole = own[:n] == own[size - 1 :]
        rows.append(np.bincount((own[:n] * GRAM_BUCKETS + bucket)[whole], minlength=len(some) * GRAM_BUCKETS).reshape(-1, GRAM_BUCKETS).astype(np.int32))
    return np.concatenate(rows or [np.zeros((0, GRAM_BUCKETS), dtype=np.int32)])


def _may_repeat(n: int, grams: np.ndarray, lengths: np.ndarray, kept: np.ndarray, ratio: float = REPEAT_RATIO, spread: float = REPEAT_LENGTH, size: int = 3) -> np.ndarray:
    """Places of the kept texts that can reach the ratio and whose length differs by less than spread of n; none that does is missed.

    A text of n characters with c of them in common with one of m keeps all but 3 (n - c) + 2 (m - c) of its n - 2 pieces of three,
    all but 2 (n - c) + (m - c) of its n - 1 pieces of two and all but n - c of its characters. Pieces that share a bucket only raise
    the count.
    """
    near = np.flatnonzero(np.abs(lengths - n) < spread * n)
    common = np.ceil(ratio / 200 * (lengths[near] + n) - 1e-6)
    least = n - (size - 1) - size * (n - common) - (size - 1) * (lengths[near] - common)
    shared = np.concatenate([np.minimum(kept[near[i : i + 4096]], grams).sum(axis=1) for i in range(0, len(near), 4096)] or [np.zeros(0)])
    return near[(common <= np.minimum(lengths[near], n)) & (shared >= least)]


def kept_paragraphs(paras: DataFrame) -> DataFrame:
    """Greedy removal of repeats within a chapter: a paragraph goes if it is nearly the same as one that was kept before it, in its section or an earlier one.

    Exact copies are found by key without comparing; else only paragraphs of a similar length with enough three-character pieces in
    common are compared. A section without chapter (or paragraphs without the columns chapter_id and section_no) is a chapter of its own.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["section_no", "section_id", "para_no"])
        kept: list[str] = []
        seen: set[str] = set()
        lengths, grams = np.zeros(64, dtype=np.int64), np.zeros((64, GRAM_BUCKETS), dtype=np.int32)
        out = []
        for text in part["norm"]:
            n, own, k = len(text), _grams(text) if len(text) > 2 else np.zeros(GRAM_BUCKETS, dtype=np.int32), len(kept)
            repeat = n >= REPEAT_CHARS and (text in seen or any(indel_ratio(kept[i], text) >= REPEAT_RATIO for i in _may_repeat(n, own, lengths[:k], grams[:k])))
            out.append(not repeat)
            if not repeat:
                if k == len(lengths):
                    lengths, grams = np.concatenate([lengths, np.zeros_like(lengths)]), np.concatenate([grams, np.zeros_like(grams)])
                lengths[k], grams[k] = n, own
                kept.append(text)
                seen.add(text)
        return part.assign(kept=out)[["book_id", "section_id", "para_no", "kept"]]

    known = {"chapter_id", "section_no"} <= set(paras.columns)
    chapter, section_no = (F.col("chapter_id"), F.col("section_no")) if known else (F.lit(None).cast("string"), F.lit(None).cast("int"))
    alone = F.when(chapter.isNull(), F.col("section_id"))
    rows = paras.select("book_id", "section_id", "para_no", chapter.alias("chapter_id"), section_no.alias("section_no"), alone.alias("alone"), F.lower(X.squash(F.col("para"))).alias("norm"))
    return rows.groupBy("book_id", "chapter_id", "alone").applyInPandas(fold, "book_id string, section_id string, para_no int, kept boolean")


def near_duplicate_lines(lines: DataFrame, least: int = 60, ratio: float = 85.0) -> DataFrame:
    """near_duplicate: a line outside quiz and recap that says nearly the same, in other characters, as an earlier one of its episode; claim_id is the first such line.

    Every earlier line is compared that can reach the ratio by length and by pieces of three, one and two characters, so none is missed; lines of equal text are compared once.
    """
    flat = lines.where(~F.col("seg_type").isin("quiz", "recap")).select(*EPISODE, "pos", "line_id", X.flat(F.col("text")).alias("flat"))

    schema = pa.schema([(c, pa.int32() if c == "revision" else pa.string()) for c in (*EPISODE, "rule", "severity", "line_id", "claim_id")])

    def fold(part: pa.Table) -> pa.Table:
        part = part.sort_by([("pos", "ascending"), ("line_id", "ascending")])
        said = part["flat"].to_pylist()
        texts = list(dict.fromkeys(said))
        number = {text: i for i, text in enumerate(texts)}
        ids: list[str] = []  # of the first line of each text that was met
        twins: dict[str, str | None] = {}
        lengths, (three, *less) = np.array([len(t) for t in texts], dtype=np.int64), [(size, _pieces(texts, size)) for size in (3, 1, 2)]
        found = []
        for text, line_id in zip(said, part["line_id"].to_pylist()):
            own, k = number[text], len(ids)
            if twins.get(text) is not None:
                found.append((line_id, twins[text]))
                continue
            later = own + 1 if own < k else 0  # an equal text was compared with those before it
            near = later + _may_repeat(len(text), three[1][own], lengths[later:k], three[1][later:k], ratio, 1.0)
            for size, counts in less:
                near = near[_may_repeat(len(text), counts[own], lengths[near], counts[near], ratio, 1.0, size)] if len(near) else near
            twin = next((ids[i] for i in near if indel_ratio(texts[i], text) >= ratio), None)
            twins[text] = twin
            if twin is not None:
                found.append((line_id, twin))
            if own == k:
                ids.append(line_id)
        episode = {c: [part[c][0].as_py()] * len(found) if found else [] for c in EPISODE}
        return pa.table(episode | {"rule": ["near_duplicate"] * len(found), "severity": ["warning"] * len(found), "line_id": [a for a, _ in found], "claim_id": [b for _, b in found]}, schema)

    return flat.where(F.length("flat") >= least).groupBy(*EPISODE).applyInArrow(fold, "book_id string, episode_id string, revision int, rule string, severity string, line_id string, claim_id string")
