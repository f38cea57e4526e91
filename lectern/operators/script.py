"""Quality rules over dialogue lines. Every rule is a DataFrame of findings; ``audit`` is their union.

Lines are one row per (book_id, episode_id, revision, line_id), see ``script_lines``. Findings have the columns of ``FINDING``.
A line whose text is null breaks no rule on text; an episode without lines has no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.session import kept

EPISODE = ["book_id", "episode_id", "revision"]
FINDING = [*EPISODE, "rule", "severity", "line_id", "claim_id"]
# Bounds of the rules.
CHARS_PER_SECOND, SECONDS_PER_LINE = 15.0, 0.3
FACT_SEGMENTS, RETELLING = ["body", "guest", "reexplain", "quiz", "recap"], ["cold_open", "quiz", "recap", "reexplain", "outro"]
NARRATIVE = ["cold_open", "body", "guest", "reexplain"]
DEFINING = "\\b(is een|zijn een|heet|heten|noemen we|betekent|wil zeggen)\\b"
STOCK = "(?i)(^|[^\\p{L}\\p{N}_])(is|zijn|blijft|blijven)\\s+(nog\\s+)?geen([^\\p{L}\\p{N}_]|$)"
SOURCE_TALK = "(?i)(^|[^\\p{L}\\p{N}_])(in de tekst|de tekst|de bron|volgens de bron|het boek|er staat|staat er)([^\\p{L}\\p{N}_]|$)"
PHRASES = ["fascinerend", "goede vraag", "deep dive", "welkom bij", "welkom terug", "het mooie is", "samengevat", "samenvattend", "kortom", "in essentie", "in een notendop", "het grappige is", "eerlijk gezegd"]
#: The reference's list; PHRASES, on which the SQL of the queries is built, has 11 of them and two of its own.
BANNED_PHRASES = [
    "dat is echt fascinerend", "fascinerend", "goede vraag", "goeie vraag", "geweldige vraag", "uitstekende vraag", "laten we eens duiken in",
    "laten we duiken in", "duiken we in", "diep duiken", "deep dive", "aan het eind van de dag", "aan het einde van de dag", "welkom bij",
    "welkom terug", "in deze aflevering", "vandaag gaan we het hebben over", "vandaag hebben we het over", "dat is een interessante",
    "interessant punt", "super interessant", "heel interessant", "wat een reis", "game changer", "gamechanger", "het mooie is",
    "laten we het even samenvatten", "om het samen te vatten", "samengevat", "samenvattend", "kortom", "dus wat hebben we geleerd",
    "wat hebben we vandaag geleerd", "als we terugkijken", "even recapituleren", "de takeaway", "take-away", "belangrijkste inzicht", "ontrafelen",
    "de essentie is", "in essentie", "in een notendop", "dat brengt ons bij", "dat brengt ons naadloos", "zonder verder oponthoud",
    "zoals we allemaal weten", "het is belangrijk om te onthouden", "het is belangrijk om te benadrukken", "essentieel om te begrijpen",
    "cruciaal om te begrijpen", "tot de volgende keer", "bedankt voor het luisteren",
]
_W, _S = "[\\p{L}\\p{N}_]", "[\\s\\p{Z}]"
#: Named patterns over the stored text: name, severity, expression.
PATTERNS = [
    ("summary_opener", "blocking", f"(?iu)^{_S}*(dus|oké|ok|nou|goed)?[,.]?{_S}*(samengevat|samenvattend|kortom|om (het|dit|alles) (even )?samen te vatten|wat we (dus |nu )?(hebben )?geleerd (hebben)?|als (we|ik) (het )?even (terug|samen){_W}*)"),
    ("not_x_but_y", "warning", f"(?iu){X.BEFORE}niet{_S}+(alleen{_S}+)?{_W}+({_S}+{_W}+){{0,4}},?{_S}+maar{_S}+(ook{_S}+)?{_W}+"),
    ("three_part_flourish", "warning", f"(?iu){X.BEFORE}({_W}{{3,}}),{_S}+({_W}{{3,}}){_S}+en{_S}+({_W}{{3,}})[.!?]"),
]
FILLER = f"^(oké dus|oke dus|nou|dus|ja)[,.]?{_S}*"


def script_lines(raw: DataFrame) -> DataFrame:
    """One row per line: repeated rows once, speakers trimmed and lower-cased, the overlap flattened."""
    return raw.select(
        *EPISODE, "seg_no", "seg_type", "line_no", "pos", "line_id", F.lower(F.trim("speaker")).alias("speaker"), "text", F.coalesce("pause_after_ms", F.lit(0)).alias("pause_after_ms"), "target_minutes",
        F.coalesce("overlap.mode", F.lit("none")).alias("mode"), F.col("overlap.target").alias("target"), F.col("overlap.cut_word").alias("cut_word"),
        F.coalesce("covers", F.array().cast("array<string>")).alias("covers"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "delivery", "mood", "timing", "reaction",
    ).dropDuplicates([*EPISODE, "line_id"])


def latest_revision(lines: DataFrame) -> DataFrame:
    """Lines of each episode's highest revision; a null revision is lower than any."""
    top = lines.groupBy("book_id", "episode_id").agg(F.max("revision").alias("revision"))
    return lines.join(top, EPISODE, "left_semi")


def _order() -> Window:
    return Window.partitionBy(*EPISODE).orderBy("pos", "line_id")


def found(df: DataFrame, rule: str | Column, severity: str = "blocking", line: str = "line_id", claim: str | None = None) -> DataFrame:
    name = F.lit(rule) if isinstance(rule, str) else rule
    return df.select(*EPISODE, name.alias("rule"), F.lit(severity).alias("severity"), F.col(line).cast("string").alias("line_id"), (F.col(claim) if claim else F.lit(None).cast("string")).alias("claim_id"))


def with_previous(lines: DataFrame) -> DataFrame:
    """Each line with the line before it in the episode, across segments."""
    w = _order()
    return lines.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("line_id", "speaker", "text", "seg_no", "tags", "mode", "pause_after_ms")])


def frame_rules(lines: DataFrame) -> DataFrame:
    """no_cold_open, no_outro."""
    ends = lines.groupBy(*EPISODE).agg(F.min_by("seg_type", "pos").alias("first"), F.max_by("seg_type", "pos").alias("last"), F.lit(None).cast("string").alias("line_id"))
    return found(ends.where("first <> 'cold_open'"), "no_cold_open", "warning").unionByName(found(ends.where("last <> 'outro'"), "no_outro", "warning"))


def cast_rules(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """unknown_speaker, guest_outside_guest_segment. The cast is joined by id; a speaker that isn't in it is unknown."""
    cast = speakers.select(F.lower("id").alias("speaker"), "kind").dropDuplicates(["speaker"])
    joined = lines.join(cast, "speaker", "left")
    unknown = found(joined.where("kind is null"), "unknown_speaker")
    return unknown.unionByName(found(joined.where("kind = 'guest' and seg_type <> 'guest'"), "guest_outside_guest_segment"))


def overlap_rules(lines: DataFrame) -> DataFrame:
    """The ladder of overlap targets, one finding a line, and the rules on the line that is overlapped."""
    p = with_previous(lines).where("mode <> 'none'")
    ladder = F.when(F.col("line_no") == 1, "overlap_at_segment_start").when(~F.col("target").eqNullSafe(F.col("prev_line_id")), "overlap_target").when(F.col("speaker").eqNullSafe(F.col("prev_speaker")), "overlap_same_speaker")
    out = found(p.withColumn("ladder", ladder).where("ladder is not null"), F.col("ladder"))
    cut = p.where("mode = 'interrupt' and prev_text is not null")
    out = out.unionByName(found(cut.where(~X.ends_in_fragment(F.col("prev_text"))), "interrupt_without_fragment", line="prev_line_id"))
    out = out.unionByName(found(cut.where(F.expr("cut_word is not null and locate(lower(cut_word), lower(prev_text)) = 0")), "cut_word_missing", "warning"))
    out = out.unionByName(found(p.where((F.col("mode") == "backchannel") & (X.word_count(F.col("text")) > 8)), "backchannel_too_long"))
    return out.unionByName(found(p.where(F.col("prev_text").rlike("[0-9]") | F.lower("prev_text").rlike(DEFINING)), "overlap_over_content"))


def coverage_rules(lines: DataFrame, claims: DataFrame, least: int = 3) -> DataFrame:
    """missing_claim (required by relevance, told by no line) and unknown_claim (told but not in the plan), per episode."""
    told = lines.select(*EPISODE, "line_id", F.explode("covers").alias("claim_id"))
    plan = claims.select("book_id", F.col("chapter_id").alias("episode_id"), "claim_id", "exam_relevance").dropDuplicates(["book_id", "episode_id", "claim_id"])
    episodes = lines.select(*EPISODE).distinct()
    needed = episodes.join(plan.where(F.col("exam_relevance") >= least), ["book_id", "episode_id"])
    missing = needed.join(told, [*EPISODE, "claim_id"], "left_anti").withColumn("line_id", F.lit(None).cast("string"))
    unknown = told.where(~F.col("claim_id").contains(":")).join(plan, ["book_id", "episode_id", "claim_id"], "left_anti")
    return found(missing, "missing_claim", claim="claim_id").unionByName(found(unknown, "unknown_claim", "warning", claim="claim_id"))


def phrase_rule(lines: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """banned_phrase: a phrase of the list as whole words; one pattern over all phrases keeps it one pass, one finding a line and phrase."""
    listed = sorted(set(phrases or BANNED_PHRASES + PHRASES))
    said = F.col("said")
    hits = F.filter(F.array(*map(F.lit, listed)), lambda p: said.contains(p) & F.rlike(said, X.whole_word(p)))
    alternatives = "|".join(f"\\Q{p}\\E" for p in listed)
    near = lines.select(*EPISODE, "line_id", F.lower(X.squash(F.col("text"))).alias("said")).where(said.rlike(f"{X.BEFORE}({alternatives}){X.AFTER}"))
    # explode_outer: for explode, Spark would look for every phrase a second time, to leave out lines without any.
    return found(near.select(*EPISODE, "line_id", F.explode_outer(hits).alias("phrase")).where("phrase is not null"), "banned_phrase", claim="phrase")


def pattern_rules(lines: DataFrame, patterns: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """summary_opener, not_x_but_y, three_part_flourish: one finding a line and pattern, the severity given with the pattern."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("level"), F.lit(r).alias("pattern")) for n, s, r in (patterns or PATTERNS)])
    hits = lines.select(*EPISODE, "line_id", F.explode_outer(F.filter(rules, lambda r: F.rlike(F.col("text"), r["pattern"]))).alias("hit")).where("hit is not null")
    return hits.select(*EPISODE, F.col("hit.name").alias("rule"), F.col("hit.level").alias("severity"), "line_id", F.lit(None).cast("string").alias("claim_id"))


def definition_recital(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """A line that reads out definitions(book_id, episode_id, term): what stands before its first colon, a filler word aside, is a term."""
    bare = F.regexp_replace(F.lower(X.squash(F.col("text"))), FILLER, "")
    head = lines.where(F.col("text").contains(":")).withColumn("term", F.trim(F.substring_index(bare, ":", 1)))
    terms = definitions.select("book_id", "episode_id", F.trim(F.lower("term")).alias("term")).distinct()
    return found(head.join(terms, ["book_id", "episode_id", "term"]), "definition_recital", claim="term")


def _markers(speakers: DataFrame) -> DataFrame:
    return speakers.select(F.lower("id").alias("owner"), F.explode("tic_markers").alias("marker")).where("trim(marker) <> ''").select("owner", F.lower("marker").alias("marker")).distinct()


def _by_first_word(lines: DataFrame, text: str, terms: DataFrame, term: str, on: list[str]) -> DataFrame:
    """lines(episode, line_id, text, ...) with every term of terms(term, *on, ...) that the lower-cased text holds as a whole word.

    A term meets a line by its first word ('' if it has none), so no line is compared with every term; only keys and words are
    exploded, and the text comes back for the pairs that are left.
    """
    bare = F.lit("")
    first = terms.withColumn("word", F.coalesce(F.get(X.words(F.col(term)), F.lit(0)), bare))
    each = lines.select(*EPISODE, "line_id", F.explode(F.array_distinct(F.concat(X.words(F.lower(text)), F.array(bare)))).alias("word"))
    pairs = each.join(first, [*on, "word"]).drop("word")
    back = lines.join(pairs, list(dict.fromkeys([*EPISODE, "line_id", *on])))
    return back.where(F.expr(f"instr(lower({text}), {term}) > 0") & F.rlike(F.lower(text), X.whole_word(F.col(term))))


def tic_leak(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """A line with another speaker's marker."""
    hit = _by_first_word(lines.select(*EPISODE, "line_id", "speaker", "text"), "text", _markers(speakers), "marker", [])
    return found(hit.where("speaker <> owner"), "tic_leak", claim="marker")


def tic_overuse(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """A speaker's own marker on more than 1 + n/15 of its n lines in a segment; the finding is the line after the last allowed one."""
    seg = [*EPISODE, "seg_no", "speaker"]
    total = lines.withColumn("allowed", 1 + F.floor(F.count(F.lit(1)).over(Window.partitionBy(*seg)) / 15))
    own = total.join(_markers(speakers).withColumnRenamed("owner", "speaker"), "speaker").where(F.rlike(F.lower("text"), X.whole_word(F.col("marker"))))
    nth = own.withColumn("nth", F.row_number().over(Window.partitionBy(*seg, "marker").orderBy("pos")))
    return found(nth.where("nth = allowed + 1"), "tic_overuse", claim="marker")


def repeated_opening(lines: DataFrame) -> DataFrame:
    """At least three and at least 40 % of a speaker's five or more lines in a segment begin with the same two words; the third is found."""
    seg = [*EPISODE, "seg_no", "speaker"]
    o = lines.withColumn("opening", X.opening(F.col("text"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*seg))).where("opening <> ''")
    same = o.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(*seg, "opening"))).withColumn("nth", F.row_number().over(Window.partitionBy(*seg, "opening").orderBy("pos")))
    return found(same.where("n >= 5 and same >= 3 and same >= 0.4 * n and nth = 3"), "repeated_opening", claim="opening")


def duplicate_lines(lines: DataFrame, least: int = 40) -> DataFrame:
    """duplicate_line: the same key as an earlier line of the episode, with that first line as claim_id."""
    keyed = lines.where("seg_type not in ('quiz', 'recap')").withColumn("key", X.bare_key(F.col("text"))).where(F.length("key") >= least)
    w = Window.partitionBy(*EPISODE, "key").orderBy("pos")
    seen = keyed.withColumn("first_id", F.first("line_id").over(w)).withColumn("nth", F.row_number().over(w))
    return found(seen.where("nth > 1"), "duplicate_line", claim="first_id")


def formula_rules(lines: DataFrame) -> DataFrame:
    """stock_phrase and source_talk: counted in the episode, found once a segment."""
    short = F.exists(F.split(X.squash(F.col("text")), "(?<=[.!?])\\s+"), lambda s: s.rlike(STOCK) & (F.size(F.split(s, "\\s+")) <= 9))
    out = None
    for rule, hit, most in (("stock_phrase", short, 3), ("source_talk", F.col("text").rlike(SOURCE_TALK), 2)):
        h = lines.where(hit).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*EPISODE))).withColumn("nth", F.row_number().over(Window.partitionBy(*EPISODE, "seg_no").orderBy("pos")))
        hits = found(h.where((F.col("n") > most) & (F.col("nth") == 1)), rule)
        out = hits if out is None else out.unionByName(hits)
    return out


def retelling_rules(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """claim_repeated: told in a second telling segment; skeptic_fact: first of all told by the skeptic, in a telling segment."""
    told = lines.select(*EPISODE, "pos", "seg_no", "seg_type", "speaker", "line_id", F.explode(F.array_distinct("covers")).alias("claim_id")).where("not contains(claim_id, ':')")
    telling = told.where(~F.col("seg_type").isin(*RETELLING))
    home = F.first("seg_no").over(Window.partitionBy(*EPISODE, "claim_id").orderBy("pos"))
    repeated = telling.withColumn("home", home).where("home <> seg_no")
    first = told.withColumn("first_pos", F.min("pos").over(Window.partitionBy(*EPISODE, "claim_id"))).where("pos = first_pos")
    skeptic = speakers.where("role = 'skeptic'").select(F.lower("id").alias("speaker")).distinct()
    early = first.where(~F.col("seg_type").isin(*RETELLING)).join(skeptic, "speaker", "left_semi")
    return found(repeated, "claim_repeated", "warning", claim="claim_id").unionByName(found(early, "skeptic_fact", "warning", claim="claim_id"))


def speakable_rules(lines: DataFrame) -> DataFrame:
    """written_syntax, number_overload, uncovered_fact."""
    out = found(lines.where(F.col("text").contains(";") | ((F.size("covers") > 0) & F.col("text").rlike(":\\s+\\S"))), "written_syntax", "warning")
    out = out.unionByName(found(lines.where(F.regexp_count("text", F.lit("[0-9]+([.,][0-9]+)?")) > 3), "number_overload", "warning"))
    bare = lines.where((F.size("covers") == 0) & F.col("seg_type").isin(*FACT_SEGMENTS) & F.col("text").rlike("[0-9]") & (F.length("text") > 60))
    return out.unionByName(found(bare, "uncovered_fact", "warning"))


def telegraphic(lines: DataFrame) -> DataFrame:
    """Segments in which at least two and a fifth of the substantive lines are strings of very short sentences; the first four such lines."""
    sized = lines.where(F.col("seg_type").isin(*NARRATIVE)).withColumn("lens", X.sentence_lengths(F.col("text"))).withColumn("total", F.aggregate("lens", F.lit(0), lambda a, x: a + x))
    marked = sized.where("total >= 6").withColumn("hit", (F.size("lens") >= 2) & (F.col("total") / F.size("lens") < 5))
    seg = Window.partitionBy(*EPISODE, "seg_no")
    counted = marked.withColumn("hits", F.sum(F.col("hit").cast("int")).over(seg)).withColumn("lines", F.count(F.lit(1)).over(seg)).where("hit and hits >= 2 and hits >= 0.2 * lines")
    return found(counted.withColumn("nth", F.row_number().over(seg.orderBy("pos"))).where("nth <= 4"), "telegraphic", "warning")


def episode_stats(lines: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """Questions count in a quiz if the skeptic of the cast asks them (without a cast: anyone). Lines, characters, estimated minutes, overlaps and quiz facts of each episode, in one aggregation."""
    quiz_no = F.min(F.when(F.col("seg_type") == "quiz", F.col("seg_no"))).over(Window.partitionBy(*EPISODE))
    q = lines.withColumn("in_quiz", F.col("seg_no") == quiz_no)
    if speakers is None:
        q = q.withColumn("asks", F.lit(True))
    else:
        skeptics = speakers.where("role = 'skeptic'").select(F.lower("id").alias("speaker"), F.lit(True).alias("asks")).distinct()
        q = q.join(skeptics, "speaker", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    seconds = F.sum(F.length("text")) / CHARS_PER_SECOND + F.count(F.lit(1)) * SECONDS_PER_LINE + F.sum("pause_after_ms") / 1000
    stats = q.groupBy(*EPISODE).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"), F.round(seconds / 60, 4).alias("minutes"), F.max("target_minutes").alias("target_minutes"),
        F.count_if(F.col("mode") == "interrupt").alias("interrupts"), F.count_if(F.col("mode") == "backchannel").alias("backchannels"),
        F.coalesce(F.bool_or("in_quiz"), F.lit(False)).alias("has_quiz"), F.count_if(F.col("in_quiz") & F.col("text").contains("?") & F.col("asks")).alias("quiz_questions"),
        F.coalesce(F.max(F.when(F.col("in_quiz"), F.col("pause_after_ms"))), F.lit(0)).alias("quiz_pause"),
    )
    return stats


def budget_rules(stats: DataFrame) -> DataFrame:
    """too_many_interrupts, too_few_overlaps, duration, quiz_questions, quiz_pause."""
    s = stats.withColumn("line_id", F.lit(None).cast("string"))
    wanted = F.when(F.col("target_minutes") < 10, 2).when(F.col("target_minutes") < 18, 3).otherwise(4)
    minutes = F.greatest(F.col("minutes"), F.lit(1.0))
    checks = [
        ("too_many_interrupts", "blocking", F.col("interrupts") > F.ceil(minutes / 10 * 4)),
        ("too_few_overlaps", "warning", F.col("interrupts") + F.col("backchannels") < F.greatest(F.lit(1), F.ceil(F.col("minutes") / 10 * 2))),
        ("duration", "warning", (F.col("minutes") < 0.8 * F.col("target_minutes")) | (F.col("minutes") > 1.25 * F.col("target_minutes"))),
        ("quiz_questions", "warning", F.col("has_quiz") & (F.col("quiz_questions") < wanted)),
        ("quiz_pause", "warning", F.col("has_quiz") & (F.col("quiz_pause") <= 0)),
    ]
    out = None
    for rule, severity, when in checks:
        hits = found(s.where(when), rule, severity)
        out = hits if out is None else out.unionByName(hits)
    return out


def flat_reaction(lines: DataFrame) -> DataFrame:
    """Share of tagged answers to tagged lines of another speaker is below 0.3, where there are at least four such answers."""
    pairs = with_previous(lines).where("size(prev_tags) > 0 and speaker <> prev_speaker")
    rate = pairs.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("tags") > 0).alias("tagged")).withColumn("line_id", F.lit(None).cast("string"))
    return found(rate.where("n >= 4 and tagged / n < 0.3"), "flat_emotional_reaction", "warning")


def audit_parts(lines: DataFrame, claims: DataFrame, speakers: DataFrame) -> list[DataFrame]:
    """The rules of ``audit``, each as its own findings."""
    return [
        frame_rules(lines), cast_rules(lines, speakers), overlap_rules(lines), coverage_rules(lines, claims), phrase_rule(lines), tic_leak(lines, speakers), tic_overuse(lines, speakers),
        repeated_opening(lines), duplicate_lines(lines), formula_rules(lines), retelling_rules(lines, speakers), speakable_rules(lines), telegraphic(lines), budget_rules(episode_stats(lines, speakers)), flat_reaction(lines),
    ]


def audit(lines: DataFrame, claims: DataFrame, speakers: DataFrame) -> DataFrame:
    """All rules as one list of findings. The lines are kept once, by episode and in order, so that no rule sorts or shuffles them anew."""
    lines = kept(lines.repartition(*EPISODE).sortWithinPartitions(*EPISODE, "pos", "line_id"))
    out, *rest = audit_parts(lines, claims, speakers)
    for part in rest:
        out = out.unionByName(part)
    return out


def full_audit(lines: DataFrame, claims: DataFrame, speakers: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """``audit`` with the named patterns and, where a plan's definitions are given, definition_recital."""
    out = audit(lines, claims, speakers).unionByName(pattern_rules(lines))
    return out if definitions is None else out.unionByName(definition_recital(lines, definitions))


def overlap_over_terms(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """overlap_over_content for terms: an overlap on a line that holds a loanword or notation of the book's lexicon as a whole word."""
    over = with_previous(lines).where("mode <> 'none' and prev_text is not null").select(*EPISODE, "line_id", "prev_text")
    terms = lexicon.where("kind in ('loanword_en', 'notation', 'loanword')").select("book_id", F.lower(F.trim("surface")).alias("term")).where("length(term) > 1").distinct()
    return found(_by_first_word(over, "prev_text", terms, "term", ["book_id"]).select(*EPISODE, "line_id").distinct(), "overlap_over_content")


def empty_rules(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """segments(episode, seg_no or null) -> empty_script: an episode without segments; empty_segment: a segment without lines (claim_id is its number)."""
    none = segments.groupBy(*EPISODE).agg(F.count("seg_no").alias("n"), F.lit(None).cast("string").alias("line_id")).where("n = 0")
    bare = segments.where("seg_no is not null").select(*EPISODE, "seg_no").distinct().join(lines.select(*EPISODE, "seg_no").distinct(), [*EPISODE, "seg_no"], "left_anti")
    bare = bare.select(*EPISODE, F.lit(None).cast("string").alias("line_id"), F.col("seg_no").cast("string").alias("claim_id"))
    return found(none, "empty_script").unionByName(found(bare, "empty_segment", claim="claim_id"))


def verdicts(findings: DataFrame) -> DataFrame:
    """Counts by severity and whether the episode passes, per episode with findings."""
    return findings.groupBy(*EPISODE).agg(F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warnings"), (~F.bool_or(F.col("severity") == "blocking")).alias("passed"))


def best_revision(findings: DataFrame) -> DataFrame:
    """Per episode the revision with the fewest blocking findings, then warnings, the later one on a tie."""
    v = verdicts(findings)
    return v.groupBy("book_id", "episode_id").agg(F.min_by("revision", F.struct("blocking", "warnings", -F.col("revision"))).alias("best_revision"))


def turn_numbers(lines: DataFrame) -> DataFrame:
    """Lines with turn_no: a new turn at a new segment or speaker, at an own overlap, after a pause and after an overlap."""
    p = with_previous(lines)
    new = F.col("prev_line_id").isNull() | (F.col("seg_no") != F.col("prev_seg_no")) | ~F.col("speaker").eqNullSafe(F.col("prev_speaker")) | (F.col("mode") != "none") | (F.col("prev_pause_after_ms") > 0) | (F.col("prev_mode") != "none")
    return p.withColumn("turn_no", F.sum(F.when(new, 1).otherwise(0)).over(_order()))


def turns(lines: DataFrame) -> DataFrame:
    """Speaker turns with their lines, words and characters."""
    return turn_numbers(lines).groupBy(*EPISODE, "turn_no").agg(F.min_by("speaker", "pos").alias("speaker"), F.min_by("seg_type", "pos").alias("seg_type"), F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("lines"), F.sum(X.word_count(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("chars"))


def renumbered(lines: DataFrame) -> DataFrame:
    """Line ids l001, l002, ... in order, overlap targets rewritten along; a target that doesn't exist becomes null."""
    new = lines.withColumn("new_id", F.format_string("l%03d", F.row_number().over(_order())))
    ids = new.select(*EPISODE, F.col("line_id").alias("target"), F.col("new_id").alias("new_target"))
    return new.join(ids, [*EPISODE, "target"], "left").select(*EPISODE, "pos", "line_id", "new_id", "target", "new_target")
