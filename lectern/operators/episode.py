"""Episode arithmetic: length and shape of an episode, parts that one reading takes, outlines, routing of findings, choice of people.

Everything is per chapter or episode: windows and aggregates over keys, one fold over lengths where packing is greedy.
Null texts count as empty; a chapter without claims has no row; repeated claims must be taken out before (``planning.claims_once``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import cues as C
from lectern.functions import performance as V
from lectern.functions import text as X
from lectern.operators import planning as P
from lectern.operators.fuzzy import token_set_ratio
from lectern.operators.matching import indel_ratio
from lectern.operators.script import EPISODE

# Seconds of the parts of an episode, and bounds of its shape.
COLD_OPEN, OUTRO, RECAP, QUIZ_QUESTION, REEXPLAIN, MOMENT, MISCONCEPTION, GUEST_INTRO = 55.0, 40.0, 90.0, 50.0, 120.0, 45.0, 10.0, 40.0
GUEST_FACTOR, GUEST_MINUTES, LEAST_MINUTES, REEXPLAIN_DIFFICULTY, SHORTFALL, LEAST_BODY, MOST_MOMENTS = 1.3, 15, 6, 4, 0.9, 180.0, 2
PART_CHARS, FLAT_SEGMENTS = 8000, 3
GUEST_SCORE, NAME_SCORE, OPENER_SCORE, BLOCK_SCORE = 55.0, 85.0, 60.0, 50.0
NATURALNESS = ["too_few_overlaps", "flat_emotional_reaction", "cut_word_missing", "quiz_pause", "ignores_previous", "stiff", "formal", "forced_image", "telegraphic", "source_copy", "claim_repeated", "near_duplicate", "skeptic_fact", "term_before_intro", "written_syntax", "number_overload", "unknown_word", "no_antecedent", "unanswered", "nonsense", "contradicts", "not_landed"]
COMPREHENSION = ["no_antecedent", "unanswered", "nonsense", "contradicts", "not_landed"]


def quiz_questions(minutes: Column) -> Column:
    return F.when(minutes < 10, 2).when(minutes < 18, 3).otherwise(4)


def _seconds(difficulty: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in P.CLAIM_SECONDS.items() for x in kv]), difficulty).cast("double")


def _chapters(claims: DataFrame) -> DataFrame:
    """Per chapter: claims, seconds of all and of the guest's claims, and the highest difficulty."""
    guest = P.guest_claims(claims).select(*P.CHAPTER, "claim_id", F.lit(True).alias("guest"))
    c = claims.join(guest, [*P.CHAPTER, "claim_id"], "left").withColumn("s", _seconds(F.col("difficulty")))
    return c.groupBy(*P.CHAPTER).agg(F.count(F.lit(1)).alias("claims"), F.sum("s").alias("all_s"), F.coalesce(F.sum(F.when(F.col("guest"), F.col("s"))), F.lit(0.0)).alias("guest_s"), F.max("difficulty").alias("hardest"))


def episode_minutes(claims: DataFrame, most: int = 30, with_guest: bool = False) -> DataFrame:
    """(chapter, minutes): what the claims, the moments and the frame around them need, between LEAST_MINUTES and most.

    The frame depends on the number of quiz questions and that on the length: the first of 2, 3 and 4 questions that its own length allows.
    """
    c = _chapters(claims)
    moments = F.least(F.lit(MOST_MOMENTS), P._block_count(F.col("claims")))
    need = F.col("all_s") + MOMENT * moments + F.when(F.col("hardest") >= REEXPLAIN_DIFFICULTY, REEXPLAIN).otherwise(0.0) + (GUEST_INTRO if with_guest else 0.0)
    length = lambda n: F.ceil((need + COLD_OPEN + OUTRO + QUIZ_QUESTION * n) / 60)
    minutes = F.when(quiz_questions(length(2)) <= 2, length(2)).when(quiz_questions(length(3)) <= 3, length(3)).otherwise(length(4))
    return c.select(*P.CHAPTER, F.greatest(F.lit(LEAST_MINUTES), F.least(F.lit(most), minutes)).cast("int").alias("minutes"))


def episode_shape(claims: DataFrame, minutes: DataFrame, guest: bool = True, has_recap: bool = False, moments: int = 0) -> DataFrame:
    """minutes(chapter, minutes) -> (chapter, minutes, questions, body_s, quiz_s, recap_s, guest_s, reexplain_s).

    A second route for a hard claim and a guest are extras: where the body would get less than SHORTFALL of what its claims need,
    first the second route goes, then the guest.
    """
    c = _chapters(claims).join(minutes, P.CHAPTER)
    total = F.col("minutes") * 60.0
    questions = quiz_questions(F.col("minutes"))
    recap = F.least(F.lit(RECAP), 0.08 * total) if has_recap else F.lit(0.0)
    frame = COLD_OPEN + OUTRO + QUIZ_QUESTION * questions + recap
    asked = (F.col("minutes") >= GUEST_MINUTES) & F.lit(guest)
    guest_cost = F.col("guest_s") * GUEST_FACTOR + GUEST_INTRO
    second = F.col("hardest") >= REEXPLAIN_DIFFICULTY
    need = lambda with_guest: F.col("all_s") - F.when(with_guest, F.col("guest_s")).otherwise(0.0) + MOMENT * moments
    got = lambda with_guest, with_second: total - frame - F.when(with_guest, guest_cost).otherwise(0.0) - F.when(with_second, REEXPLAIN).otherwise(0.0)
    short = lambda g, s: got(g, s) < SHORTFALL * need(g)
    keep_second = second & ~short(asked, second)
    c = c.withColumn("with_second", keep_second).withColumn("with_guest", asked & ~short(asked, keep_second))
    g, s = F.col("with_guest"), F.col("with_second")
    return c.select(
        *P.CHAPTER, "minutes", questions.alias("questions"), F.greatest(F.lit(LEAST_BODY), got(g, s)).alias("body_s"), (QUIZ_QUESTION * questions).alias("quiz_s"), recap.alias("recap_s"),
        F.when(g, guest_cost).otherwise(0.0).alias("guest_s"), F.when(s, REEXPLAIN).otherwise(0.0).alias("reexplain_s"),
    )


def flat_segments(lines: DataFrame, most: int = FLAT_SEGMENTS) -> DataFrame:
    """The body segments of each episode with the fewest overlaps, the longer ones first (a top-k report)."""
    seg = lines.where("seg_type = 'body'").groupBy(*EPISODE, "seg_no").agg(F.count_if(F.col("mode") != "none").alias("overlaps"), F.count(F.lit(1)).alias("lines"))
    place = F.row_number().over(Window.partitionBy(*EPISODE).orderBy("overlaps", F.col("lines").desc(), "seg_no"))
    return seg.withColumn("place", place).where(F.col("place") <= most)


def packed(items: Column, limit: int, glue: int) -> Column:
    """items: array<struct<n: length, alone: boolean>> -> array<int> of bin numbers from 0, filled in order.

    An item that stands alone takes a bin of its own; any other opens a bin if the open one has no room for it and the glue.
    """
    start = F.struct(F.lit(-1).alias("bin"), F.lit(-1).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["alone"] | (a["used"] < 0) | (a["used"] + glue + x["n"] > limit)
        b = F.when(fresh, a["bin"] + 1).otherwise(a["bin"])
        used = F.when(x["alone"], -1).when(fresh, x["n"]).otherwise(a["used"] + glue + x["n"])
        return F.struct(b.alias("bin"), used.alias("used"), F.concat(a["out"], F.array(b)).alias("out"))

    return F.aggregate(items, start, step, lambda a: a["out"])


def section_parts(sections: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """(book_id, section_id, chapter_id, section_no, part_no, parts, text): sections in parts on paragraph boundaries; a paragraph over the limit is cut hard,
    all but its rest being parts of their own."""
    once = sections.where("text is not null").select("book_id", "section_id", "chapter_id", "section_no", "text").dropDuplicates(["book_id", "section_id"])
    pieces = F.flatten(
        F.transform(
            F.split("text", "\n\n"),
            lambda p: F.when(F.length(p) <= most, F.array(F.struct(p.alias("p"), F.lit(False).alias("alone")))).otherwise(
                F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.struct(F.substring(p, k * most + 1, F.lit(most)).alias("p"), (k < F.floor((F.length(p) - 1) / most)).alias("alone")))
            ),
        )
    )
    whole = F.array(F.struct(F.col("text").alias("p"), F.lit(False).alias("alone")))
    cut = once.withColumn("pieces", F.when(F.length("text") <= most, whole).otherwise(pieces))
    bins = packed(F.transform("pieces", lambda x: F.struct(F.length(x["p"]).alias("n"), x["alone"].alias("alone"))), most, 2)
    numbered = cut.withColumn("bins", bins).withColumn("parts", F.array_max("bins") + 1)
    each = numbered.withColumn("part_no", F.explode(F.array_distinct("bins")))
    inside = F.filter(F.arrays_zip("pieces", "bins"), lambda z: z["bins"] == F.col("part_no"))
    return each.select("book_id", "section_id", "chapter_id", "section_no", "part_no", "parts", F.array_join(F.transform(inside, lambda z: z["pieces"]["p"]), "\n\n").alias("text"))


def chapter_parts(sections: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """(book_id, chapter_id, reading_no, section_id, part_no, chars): what one reading takes; consecutive short sections share one, a section in parts takes one for each."""
    parts = section_parts(sections.where("trim(text) <> ''"), most).select("book_id", "chapter_id", "section_no", "section_id", "part_no", (F.col("parts") > 1).alias("alone"), F.length("text").alias("n"))
    ordered = parts.groupBy("book_id", "chapter_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "section_id", "part_no", "n", "alone"))).alias("items"))
    bins = packed(F.transform("items", lambda x: F.struct(x["n"].alias("n"), x["alone"].alias("alone"))), most, 0)
    each = ordered.select("book_id", "chapter_id", F.explode(F.arrays_zip("items", bins.alias("bins"))).alias("z"))
    return each.select("book_id", "chapter_id", F.col("z.bins").alias("reading_no"), "z.items.section_id", "z.items.part_no", F.col("z.items.n").alias("chars"))


def outline_repaired(claims: DataFrame, outline: DataFrame) -> DataFrame:
    """outline(chapter, block_no, place, claim_id) -> (chapter, block_no, place, claim_id, forgotten): every claim of the chapter exactly once.

    Of repeated ids the first stays, unknown ones go. A claim that the outline forgot stands right after the claim before it in
    the book, or first of all if there is none; several in a row follow one another.
    """
    known = claims.select(*P.CHAPTER, "claim_id", "claim_no")
    first = Window.partitionBy(*P.CHAPTER, "claim_id").orderBy("block_no", "place")
    given = outline.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*P.CHAPTER, "claim_id", "block_no", "place")
    chapters = given.join(known.select(*P.CHAPTER, "claim_id"), [*P.CHAPTER, "claim_id"], "left_semi").groupBy(*P.CHAPTER).agg(F.min("block_no").alias("first_block"))
    book = Window.partitionBy(*P.CHAPTER).orderBy("claim_no", "claim_id")
    all_ = known.join(chapters, P.CHAPTER).join(given, [*P.CHAPTER, "claim_id"], "left").withColumn("forgotten", F.col("block_no").isNull())
    home = F.last(F.when(~F.col("forgotten"), F.struct("block_no", "place")), ignorenulls=True).over(book)
    placed = all_.withColumn("home", home).select(*P.CHAPTER, "claim_id", "claim_no", "forgotten", F.coalesce("home.block_no", "first_block").alias("block_no"), F.coalesce("home.place", F.lit(-1)).alias("after"))
    place = F.row_number().over(Window.partitionBy(*P.CHAPTER, "block_no").orderBy("after", "forgotten", "claim_no", "claim_id"))
    return placed.withColumn("place", place).select(*P.CHAPTER, "block_no", "place", "claim_id", "forgotten")


def definition_blocks(definitions: DataFrame, claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """definitions(chapter, term), blocks(chapter, claim_id, block_no) -> (chapter, term, block_no): the first block with a claim that holds the term; each term once."""
    told = claims.join(blocks, [*P.CHAPTER, "claim_id"]).select(*P.CHAPTER, "block_no", F.lower("claim").alias("claim"))
    terms = definitions.select(*P.CHAPTER, F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    return terms.join(told, P.CHAPTER).where(F.col("claim").contains(F.col("term"))).groupBy(*P.CHAPTER, "term").agg(F.min("block_no").alias("block_no"))


def routed_findings(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with the segment that has to be rewritten: that of the line, else the first that covers the claim, else the first
    body segment; a finding on the whole episode goes to each of the flattest body segments."""
    segments = lines.select(*EPISODE, "seg_no", "line_id")
    covers = lines.select(*EPISODE, "seg_no", F.explode("covers").alias("claim_id")).groupBy(*EPISODE, "claim_id").agg(F.min("seg_no").alias("claim_seg"))
    bodies = lines.groupBy(*EPISODE).agg(F.coalesce(F.min(F.when(F.col("seg_type") == "body", F.col("seg_no"))), F.min("seg_no")).alias("body_seg"))
    by_line = findings.where("line_id is not null").join(segments, [*EPISODE, "line_id"]).select(*EPISODE, "rule", "line_id", "claim_id", "seg_no")
    rest = findings.where("line_id is null")
    by_claim = rest.where("claim_id is not null").join(covers, [*EPISODE, "claim_id"], "left").join(bodies, EPISODE).select(*EPISODE, "rule", "line_id", "claim_id", F.coalesce("claim_seg", "body_seg").alias("seg_no"))
    whole = rest.where("claim_id is null").join(flat_segments(lines).select(*EPISODE, "seg_no"), EPISODE).select(*EPISODE, "rule", "line_id", "claim_id", "seg_no")
    return by_line.unionByName(by_claim).unionByName(whole)


def rewrite_decision(findings: DataFrame, quality: bool = False) -> DataFrame:
    """(episode, needs_rewrite): not passed, or a warning that a listener can't follow, or in quality mode one on the dialogue's shape."""
    warning = F.col("severity") == "warning"
    again = (F.col("severity") == "blocking") | (warning & F.col("rule").isin(*COMPREHENSION)) | (warning & F.col("rule").isin(*NATURALNESS) & F.lit(quality))
    return findings.groupBy(*EPISODE).agg(F.bool_or(again).alias("needs_rewrite"))


def covers_resolved(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """(episode, line_id, cover, chapter_id, claim_id, known): covers as claims; 'chXX:cN' names a claim of another chapter."""
    each = lines.select(*EPISODE, "line_id", F.explode(F.array_distinct("covers")).alias("cover"))
    other = F.col("cover").contains(":")
    named = each.withColumn("chapter_id", F.when(other, F.split_part("cover", F.lit(":"), F.lit(1))).otherwise(F.col("episode_id"))).withColumn("claim_id", F.when(other, F.split_part("cover", F.lit(":"), F.lit(2))).otherwise(F.col("cover")))
    known = claims.select(*P.CHAPTER, "claim_id", F.lit(True).alias("known")).distinct()
    return named.join(known, [*P.CHAPTER, "claim_id"], "left").select(*EPISODE, "line_id", "cover", "chapter_id", "claim_id", F.coalesce("known", F.lit(False)).alias("known"))


def segment_speakers(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """(episode, seg_no, allowed): how many people may speak in a segment: the hosts, and in a guest segment the guests too."""
    n = speakers.agg(F.count_if(F.col("kind") == "host").alias("hosts"), F.count(F.lit(1)).alias("all_"))  # one row
    seg = lines.select(*EPISODE, "seg_no", "seg_type").distinct()
    return seg.join(F.broadcast(n)).select(*EPISODE, "seg_no", F.when(F.col("seg_type") == "guest", F.col("all_")).otherwise(F.col("hosts")).alias("allowed"))


def line_performance(lines: DataFrame) -> DataFrame:
    """Speakable text, reaction, exaggeration, rate and gap of each line by its labels."""
    return lines.select(
        *EPISODE, "line_id", C.speakable(F.col("text")).alias("speakable"), C.pure_reaction(F.col("text"), F.col("reaction")).alias("pure_reaction"),
        F.round(V.exaggeration_delta(F.col("delivery"), F.col("mood")), 3).alias("delta"), V.delivery_rate(F.col("delivery")).alias("rate"), F.round(V.timing_gap(F.col("timing"), F.col("line_id")), 6).alias("gap_s"),
    )


def phrase_plan(raw_lines: DataFrame) -> DataFrame:
    """(episode, line_id, phrase_no, words, rate, pause_s): the phrases of each line, or the line as one; phrases without words go."""
    once = raw_lines.dropDuplicates([*EPISODE, "line_id"])
    own = F.when(F.size("phrases") > 0, F.transform("phrases", lambda p: F.struct(p["text"].alias("text"), F.coalesce(p["delivery"], F.col("delivery")).alias("delivery"), F.coalesce(p["pause_after"], F.lit("none")).alias("pause_after"))))
    whole = F.array(F.struct(F.col("text").alias("text"), F.col("delivery").alias("delivery"), F.lit("none").alias("pause_after")))
    each = once.select(*EPISODE, "line_id", F.posexplode(F.coalesce(own, whole)).alias("phrase_no", "p"))
    words = F.size(F.filter(F.split(F.trim(C.spoken_text(F.coalesce("p.text", F.lit("")))), "[\\s\\p{Z}]+"), lambda w: w != ""))
    out = each.select(*EPISODE, "line_id", "phrase_no", words.alias("words"), V.delivery_rate(F.col("p.delivery")).alias("rate"), F.round(V.phrase_pause(F.col("p.pause_after"), F.col("line_id"), F.col("phrase_no")), 6).alias("pause_s"))
    return out.where("words > 0")


def scene_coverage(raw_lines: DataFrame) -> DataFrame:
    """Per episode: which kinds of performance occur, and whether its deliveries ask for at least three different rates."""
    present = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return raw_lines.dropDuplicates([*EPISODE, "line_id"]).groupBy(*EPISODE).agg(
        present(F.col("delivery").isNotNull()).alias("delivery"), present(F.col("mood").isNotNull()).alias("mood"), present(F.col("timing").isNotNull()).alias("timing"), present(F.col("reaction").isNotNull()).alias("reaction"),
        present(F.col("overlap.mode") == "interrupt").alias("interrupt"), present(F.col("overlap.mode") == "backchannel").alias("backchannel"), present(F.size("phrases") > 1).alias("phrases"),
        (F.count_distinct(F.bround(V.delivery_rate(F.col("delivery")), 3)) >= 3).alias("three_rates"),
    )


def reaction_coverage(raw_lines: DataFrame, speakers: DataFrame, labels: tuple[str, ...] = ("laugh", "chuckle", "sigh", "hm")) -> DataFrame:
    """(speaker, one column a label): how many lines of each label a speaker has; speakers without any have zeros."""
    once = raw_lines.dropDuplicates([*EPISODE, "line_id"]).select(F.lower(F.trim("speaker")).alias("speaker"), "reaction")
    counts = once.groupBy("speaker").agg(*[F.count_if(F.col("reaction") == x).alias(x) for x in labels])
    return speakers.select(F.lower("id").alias("speaker")).distinct().join(counts, "speaker", "left").na.fill(0, list(labels))


def _cast_rows(speakers: DataFrame, *columns: str, most: int = 10_000) -> list[tuple]:
    """The cast on the driver: a file of people, not data; more than ``most`` raise."""
    rows = speakers.select(*columns).distinct().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a cast of more than {most} people")
    return sorted((tuple(r) for r in rows), key=str)


def picked_guests(requests: DataFrame, speakers: DataFrame, generic: bool = True) -> DataFrame:
    """requests(domain, ...) with guest: the guest whose domain is most like the wanted one (over GUEST_SCORE), else (generic) the first without a domain, else the first."""
    guests = [(i, list(d or [])) for i, d in _cast_rows(speakers.where("kind = 'guest'"), "id", "domains")]
    stand_in = next((i for i, d in guests if not d), guests[0][0] if guests else None) if generic else None

    @F.pandas_udf(T.StringType())
    def guest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for wanted in part:
                scores = [(token_set_ratio(d.casefold(), wanted.casefold()), -k) for k, (_, ds) in enumerate(guests) for d in ds] if isinstance(wanted, str) and wanted else []
                best = max(scores, default=(0.0, 0))
                out.append(guests[-best[1]][0] if best[0] > GUEST_SCORE else stand_in)
            yield pd.Series(out, dtype=object)

    return requests.withColumn("guest", guest("domain"))


def resolved_speakers(rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """rows(raw, ...) with speaker: the id that is the raw name, else the one whose name or id is most like it (over NAME_SCORE), else the first of the cast."""
    cast = [(i.casefold(), n.casefold()) for i, n in _cast_rows(speakers, "id", "name")]
    ids = [i for i, _ in _cast_rows(speakers, "id", "name")]

    @F.pandas_udf(T.StringType())
    def speaker(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for raw in part:
                name = raw.strip().casefold() if isinstance(raw, str) else ""
                scores = [(100.0 if name == i else 99.9 if name == n else max(indel_ratio(name, n), indel_ratio(name, i)), -k) for k, (i, n) in enumerate(cast)]
                best = max(scores, default=(0.0, 0))
                out.append(ids[-best[1]] if best[0] > NAME_SCORE else ids[0] if ids else None)
            yield pd.Series(out, dtype=object)

    return rows.withColumn("speaker", speaker("raw"))


_PAIRS = T.ArrayType(T.StructType([T.StructField("misconception", T.IntegerType()), T.StructField("block_no", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def assign_misconceptions(texts: list[str], blocks: list[list[str]]) -> list[tuple[int, int, float]]:
    """(misconception, block, score): the best pairs first, each misconception and each block once, none under BLOCK_SCORE."""
    scored = sorted(((max((token_set_ratio(t, c) for c in claims), default=0.0), b, m) for m, t in enumerate(texts) for b, claims in enumerate(blocks)), reverse=True)
    taken_m, taken_b, out = set(), set(), []
    for score, b, m in scored:
        if score >= BLOCK_SCORE and m not in taken_m and b not in taken_b:
            taken_m.add(m)
            taken_b.add(b)
            out.append((m, b, score))
    return sorted(out)


def misconception_blocks(misconceptions: DataFrame, claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """misconceptions(chapter, no, text) -> (chapter, no, block_no, score). A chapter's misconceptions and blocks are a handful each and meet in one row."""

    @F.pandas_udf(_PAIRS)
    def pairs(texts: pd.Series, grouped: pd.Series) -> pd.Series:
        return pd.Series([assign_misconceptions(list(t), [list(b) for b in g]) for t, g in zip(texts, grouped)])

    by_block = claims.join(blocks, [*P.CHAPTER, "claim_id"]).groupBy(*P.CHAPTER, "block_no").agg(F.array_sort(F.collect_list("claim")).alias("texts"))
    chapter = by_block.groupBy(*P.CHAPTER).agg(F.array_sort(F.collect_list(F.struct("block_no", "texts"))).alias("blocks"))
    wrong = misconceptions.groupBy(*P.CHAPTER).agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("ms"))
    both = chapter.join(wrong, P.CHAPTER).withColumn("pairs", pairs(F.transform("ms", lambda m: m["text"]), F.transform("blocks", lambda b: b["texts"])))
    each = both.select(*P.CHAPTER, "ms", "blocks", F.explode("pairs").alias("p"))
    return each.select(*P.CHAPTER, F.get("ms", F.col("p.misconception"))["no"].alias("no"), F.get("blocks", F.col("p.block_no"))["block_no"].alias("block_no"), F.bround("p.score", 2).alias("score"))


def looping(text: Column, window: int = 2500, repeats: int = 6, least: int = 25) -> Column:
    """Whether the tail of an answer is one fragment over and over, numbers aside."""
    tail = F.regexp_replace(F.when(F.length(text) > window, F.substring(text, -window, window)).otherwise(text), "\\p{Nd}+", "#")
    parts = F.filter(F.transform(F.split(tail, "[\n,]"), lambda p: F.trim(p, F.lit(' \t"[],{}'))), lambda p: F.length(p) >= least)
    return F.exists(F.array_distinct(parts), lambda p: F.size(F.filter(parts, lambda q: q == p)) >= repeats)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3.2) + 1


def tail_of(text: Column, most: int = 30000) -> Column:
    """The last characters of a context."""
    return F.when(F.length(text) > most, F.substring(text, -most, most)).otherwise(text)


def slug(name: Column) -> Column:
    """Ascii name of at most 40 signs for ids; 'gast' if nothing is left."""
    from lectern.operators.matching import _WITH_MARKS, _WITHOUT

    plain = F.regexp_replace(F.translate(F.lower(name), _WITH_MARKS, _WITHOUT), "[^\\x00-\\x7f]", "")
    base = F.substring(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_")), 1, 40)
    return F.when(base == "", "gast").otherwise(base)


def slugs(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with slug: names that clash get _2, _3 and so on in order."""
    keyed = df.withColumn("base", slug(F.col(name)))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(order))
    return keyed.withColumn("nth", nth).withColumn("slug", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("nth").cast("string")))).drop("base", "nth")


def sentence_window(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: a span (0-based, end excluded) widened to whole sentences."""
    marks = [". ", "? ", "! ", "\n"]
    head = F.substring(text, F.lit(1), start)
    before = F.greatest(*[F.when(F.contains(head, F.lit(m)), F.length(head) - F.length(F.substring_index(head, m, -1)) - len(m) + 1).otherwise(0) for m in marks])
    found = [F.position(F.lit(m), text, end + 1) for m in marks]
    after = F.least(*[F.when(p > 0, p - 1) for p in found])
    return F.struct(before.alias("start"), F.least(F.length(text), F.coalesce(after, F.length(text) - 1) + 1).alias("end"))


def table_text(rows: Column, caption: Column, most: int = 30) -> Column:
    """rows: array<array<string>>, the first the header -> the table as sentences; '' without any cell."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(X.squash(c), F.lit("")))), lambda r: F.exists(r, lambda c: c != ""))
    header, body = F.get(clean, F.lit(0)), F.slice(clean, 2, 1_000_000_000)
    label = F.coalesce(F.rtrim(F.trim(caption), F.lit(".")), F.lit("Tabel"))
    name = lambda j: F.coalesce(F.nullif(F.get(header, j), F.lit("")), F.concat(F.lit("kolom "), (j + 1).cast("string")))
    columns = F.when(F.exists(header, lambda h: h != ""), F.concat(F.lit("Kolommen: "), F.array_join(F.transform(header, lambda h, j: name(j)), ", "), F.lit(".")))
    cells = lambda r: F.filter(F.transform(r, lambda v, j: F.when(v != "", F.concat(name(j), F.lit(" "), v))), lambda x: x.isNotNull())
    lines = F.transform(F.slice(body, 1, most), lambda r, i: F.concat(F.lit("Rij "), (i + 1).cast("string"), F.lit(": "), F.array_join(cells(r), ", "), F.lit(".")))
    rest = F.when(F.size(body) > most, F.concat(F.lit("Nog "), (F.size(body) - most).cast("string"), F.lit(" rijen weggelaten.")))
    parts = F.concat(F.array(F.concat(F.lit("["), label, F.lit("."))), F.array_compact(F.array(columns)), lines, F.array_compact(F.array(rest)), F.array(F.lit("]")))
    return F.when(F.size(clean) == 0, "").otherwise(F.array_join(parts, " "))
