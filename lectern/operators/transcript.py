"""Times of words, lines and blocks, unknown words and early terms of a script."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.script import CHARS_PER_SECOND, EPISODE, SECONDS_PER_LINE
from lectern.session import settled

#: Share of a line's time in which words are spoken, and the silent share before them.
VOICED, LEAD = 0.9, 0.05


def line_times(lines: DataFrame) -> DataFrame:
    """Start and end of each line when lines follow one another, pauses between them; seconds, three decimals."""
    length = F.coalesce(F.length("text"), F.lit(0)) / CHARS_PER_SECOND + SECONDS_PER_LINE
    w = Window.partitionBy(*EPISODE).orderBy("pos", "line_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = lines.withColumn("length", length).withColumn("upto", F.sum(F.col("length") + F.col("pause_after_ms") / 1000).over(w))
    end = F.col("upto") - F.col("pause_after_ms") / 1000
    return timed.select(*EPISODE, "line_id", F.round(end - F.col("length"), 3).alias("start_s"), F.round(end, 3).alias("end_s"))


def word_times(lines: DataFrame) -> DataFrame:
    """Uniform alignment: each word's share of its line's voiced time by its length plus one; numbered from 1."""
    tokens = F.filter(F.split(F.trim("text"), "\\s+"), lambda t: t != "")
    each = lines.where("text is not null").select(*EPISODE, "line_id", (F.length("text") / CHARS_PER_SECOND).alias("seconds"), F.posexplode(tokens).alias("word_no", "word"))
    w = Window.partitionBy(*EPISODE, "line_id")
    total, upto = F.sum(F.length("word") + 1).over(w), F.sum(F.length("word") + 1).over(w.orderBy("word_no"))
    lead = F.col("seconds") * LEAD
    at = lambda n: F.round(lead + F.col("seconds") * VOICED * n / F.col("total") + 1e-7, 3)
    return each.withColumn("total", total).withColumn("upto", upto).select(*EPISODE, "line_id", (F.col("word_no") + 1).alias("word_no"), "word", at(F.col("upto") - F.length("word") - 1).alias("start_s"), at(F.col("upto")).alias("end_s"))


def block_spans(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Blocks with the time span and characters of the lines that exist, and whether the stored figures agree."""
    once = blocks.select(*EPISODE, "block_id", "line_ids", "chars", "too_long").dropDuplicates([*EPISODE, "block_id"])
    asked = once.select(*EPISODE, "block_id", F.explode(F.array_distinct("line_ids")).alias("line_id"))
    timed = asked.join(line_times(lines), [*EPISODE, "line_id"]).join(lines.select(*EPISODE, "line_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")), [*EPISODE, "line_id"])
    spans = timed.groupBy(*EPISODE, "block_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n").alias("true_chars"), F.count(F.lit(1)).alias("lines"))
    return once.drop("line_ids").join(spans, [*EPISODE, "block_id"]).select(*EPISODE, "block_id", "start_s", "end_s", "lines", "true_chars", F.col("chars").eqNullSafe(F.col("true_chars")).alias("chars_agree"), F.col("too_long").eqNullSafe(F.col("true_chars") > 3000).alias("flag_agrees"))


def unknown_words(lines: DataFrame, sections: DataFrame, claims: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words of at least five letters in a book's script that its sections, claims and lexicon don't have: first line and uses."""
    word = "([\\p{L}]{5,})"

    def words(df: DataFrame, column: str) -> DataFrame:
        return df.select("book_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(word), F.lit(1)))).alias("word"))

    known = words(sections.where("text is not null"), "text").unionByName(words(claims.where("claim is not null"), "claim")).unionByName(words(lexicon.where("surface is not null"), "surface")).distinct()
    used = lines.where("text is not null").select("book_id", F.struct("episode_id", "revision", "pos", "line_id").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(1)))).alias("word"))
    counted = used.groupBy("book_id", "word").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    return counted.join(known, ["book_id", "word"], "left_anti").select("book_id", "word", F.col("first.episode_id").alias("episode_id"), F.col("first.line_id").alias("line_id"), "lines")


def early_terms(lines: DataFrame, claims: DataFrame, speakers: DataFrame) -> DataFrame:
    """term_before_intro: names in a chapter's claims (capitalised inside the sentence) that the skeptic is the first to say, outside a quiz."""
    name = "[\\p{Ll},] (\\p{Lu}\\p{Ll}{3,})"
    cast = speakers.select(F.lower("name").alias("term"))
    terms = claims.select("book_id", F.col("chapter_id").alias("episode_id"), F.explode(F.regexp_extract_all("claim", F.lit(name), F.lit(1))).alias("name")).select("book_id", "episode_id", F.lower("name").alias("term")).distinct().join(cast, "term", "left_anti")
    names = terms.groupBy("book_id", "episode_id").agg(F.collect_set("term").alias("names"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))
    # The few names of a chapter meet its lines as one array, so that no word is shuffled; of explode_outer see script.phrase_rule.
    said = lines.select(*EPISODE, "pos", "speaker", "seg_type", "line_id", "text").join(names, ["book_id", "episode_id"]).select(*EPISODE, "pos", "speaker", "seg_type", "line_id", F.explode_outer(F.array_intersect(words, "names")).alias("term")).where("term is not null")
    first = said.withColumn("nth", F.row_number().over(Window.partitionBy(*EPISODE, "term").orderBy("pos", "line_id"))).where("nth = 1")
    skeptic = speakers.where("role = 'skeptic'").select(F.lower("id").alias("speaker")).distinct()
    return first.where("seg_type <> 'quiz'").join(skeptic, "speaker", "left_semi").select(*EPISODE, "line_id", "term")


# Sounds that are no words, what stands between the parts of a compound, and the least letters of a word and a part.
WORD_SOUNDS = ["haha", "hahaha", "hehe", "hihi", "pff", "pfff", "hmm", "hmmm", "eh", "ehm", "uh", "uhm", "oeh", "jeetje", "tja", "nou", "oké", "oke", "joh", "ach", "goh", "poeh", "aha", "oei", "wauw"]
LINKS, LEAST_LETTERS = ("", "s", "e", "en"), 4
_SPOKEN = "([\\p{L}]+(?:['’][\\p{L}]+)*)"


def spoken_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(book_id, word): the words of a text column."""
    return df.where(F.col(column).isNotNull()).select("book_id", F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(_SPOKEN), F.lit(1)))).alias("word")).where("word is not null").distinct()


def _splits(words: DataFrame) -> DataFrame:
    """(book_id, word, head, rest): every way to cut a word into a part and, behind a link, a rest."""
    cuts = words.where(F.length("word") >= 2 * LEAST_LETTERS).select("book_id", "word", F.explode(F.sequence(F.lit(LEAST_LETTERS), F.length("word") - LEAST_LETTERS)).alias("cut"))
    parts = cuts.select("book_id", "word", F.substring("word", F.lit(1), F.col("cut")).alias("head"), F.expr("substring(word, cut + 1)").alias("tail"))
    linked = parts.select("book_id", "word", "head", F.explode(F.array(*[F.when(F.col("tail").startswith(x), F.expr(f"substring(tail, {len(x) + 1})")) for x in LINKS])).alias("rest"))
    return linked.where(F.length("rest") >= LEAST_LETTERS)


def unknown_words_by_episode(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(episode, word, line_id): words said in an episode that known(book_id, word) doesn't hold, nor as a compound of up to three of
    its words with a link between; each once an episode, with its first line. Short words, words in capitals and names are left alone.

    Words said, known words and what is unknown are kept, as each is read several times. A pattern that looks back is only tried at a capital.
    """
    names = "(?=\\p{Lu})(?<=[^.!?:…—\"'“‘\\s]\\s{1,3})\\p{Lu}[\\p{L}'’]*"
    bare = F.regexp_replace(F.regexp_replace("text", names, " "), "(?=\\p{Lu})(?<![\\p{L}'’])\\p{Lu}{2,}(?![\\p{L}'’])", " ")
    said = lines.where("text is not null").select(*EPISODE, "pos", "line_id", F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(_SPOKEN), F.lit(1)))).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    first = settled(said.groupBy(*EPISODE, "word").agg(F.min_by("line_id", F.struct("pos", "line_id")).alias("line_id")), placed=True)
    given = settled(known.select("book_id", "word").distinct(), placed=True)
    unknown = settled(first.select("book_id", "word").distinct().where(~F.col("word").isin(*WORD_SOUNDS)).join(given, ["book_id", "word"], "left_anti"), placed=True)
    heads = given.select("book_id", F.col("word").alias("head"))
    rests = given.select("book_id", F.col("word").alias("rest"))
    cut = settled(_splits(unknown).join(heads, ["book_id", "head"], "left_semi"))
    two = cut.join(rests, ["book_id", "rest"], "left_semi")
    inner = _splits(cut.select("book_id", F.col("rest").alias("word")).distinct()).join(heads, ["book_id", "head"], "left_semi").join(rests, ["book_id", "rest"], "left_semi").select("book_id", F.col("word").alias("rest")).distinct()
    three = cut.join(inner, ["book_id", "rest"], "left_semi")
    compounds = two.unionByName(three).select("book_id", "word").distinct()
    left = settled(unknown.join(compounds, ["book_id", "word"], "left_anti"))
    return first.join(left, ["book_id", "word"], "left_semi").select(*EPISODE, "word", "line_id")
