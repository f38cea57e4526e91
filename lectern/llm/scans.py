"""Problem 1: noise in text from scanned pages.

Printed lines are grouped by their skeleton with digits masked; groups that repeat the book's title or a chapter label are running
headers. Words are grouped by confusable-glyph skeleton; a form is a misreading of the frequent form of its skeleton if that form
is supported by context: it stands beside one of the same words, or, if far more used, in the same book. SQL windows over a
section's lines rejoin broken words and reflow paragraphs.

Null and empty texts have no damaged line and come out unchanged; repeated rows count once; a very long line or word is handled
like any other; tables stay as they are; other columns are not read. Without books rows only labels and page numbers are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import lines as L
from lectern.session import bounded_arrow_batches, kept, merged, sized_side
from lectern.sources.tables import table

#: A rare form is a misreading of the frequent one if it is at most this share of it and stands beside the same words.
RARE_SHARE = 0.12
#: At most this share, and from this many letters, the same book is context enough.
BOOK_SHARE, BOOK_LETTERS = 0.05, 6
#: Letters that a word needs before its form is judged by frequency alone.
JUDGED_LETTERS = 4
#: An odd word without a clean form is taken for a misreading if at least this share of it are letters and no digit is in it that
#: scanning makes of no letter (else it is a code).
LETTER_SHARE = 0.6
_KEY = ["book_id", "section_id"]
_HYPHENS = "-‐‑¬­⁃−"
_BREAK = re.compile(f"[^\\W_][{_HYPHENS}]$|[@€|!/][{_HYPHENS}]$")
_EDGES = re.compile("^[^\\w@€|]+|[^\\w@€|]+$")
_LEFT, _RIGHT = re.compile("[^\\w@€|]*"), re.compile("[^\\w@€|]*$")
_ODD_GLYPH = "[a-z][0-9@€|!$]+[a-z]|[a-z]\\\\/|^[a-z]{2,}[0-9|€@]+$|^[0-9|€@$]+[a-z]{3,}$"
_PLAIN_NUMBER = "^[0-9]+(e|de|ste|th|st|nd|rd|er|m|km|kg|s)?$"
_LINE = T.StructType(
    [
        T.StructField("line_no", T.IntegerType()),
        T.StructField("line", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("a", T.StringType()),
        T.StructField("b", T.StringType()),
        T.StructField("next_no", T.IntegerType()),
    ]
)


def parse(text: str, headers: L.Headers, lo: int | None, hi: int | None) -> list[tuple]:
    """Rows of _LINE. words: folded whole words of a body line; a, b, next_no: the two parts of the word broken at its end and the line of the second."""
    lines = text.split("\n")
    folded = list(map(L.fold, lines))
    kinds = L.classify(lines, folded, headers, lo, hi)
    out, body = [], None
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        words = [w for w in (t if t.isalnum() else _EDGES.sub("", t) for t in folded[i].split()) if w] if kind == L.BODY else []
        row = [i, line, kind, words, None, None, None]
        out.append(row)
        if kind == L.BODY:
            if body is not None and _BREAK.search(body[1].rstrip()[-2:]):
                body[6], body[5] = i, words[0] if words else ""
                body[4] = body[3].pop() if body[3] else ""
                row[3] = words[1:]
            body = row
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _line_keys(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, titles in parts:
        yield pd.Series([[k for line in text.split("\n") for k in (h.of(L.fold(line).strip()))] for text, h in zip(texts, map(L.headers_of, titles))])


def running_headers(titled: DataFrame) -> DataFrame:
    """titled(book_id, text, title) -> (book_id, headers): masked keys of each book's running headers.

    The book's lines are grouped by masked key; a group with the key of the title or of a chapter label, itself one more member,
    is a header's. Lines that can't have such a key are left out before they are counted, so next to nothing is shuffled.
    """
    groups = titled.select("book_id", F.explode(_line_keys("text", "title")).alias("key")).groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("lines"))
    return groups.groupBy("book_id").agg(F.collect_set("key").alias("headers"))


def _parsed(with_text: bool):
    @F.pandas_udf(T.ArrayType(_LINE))
    def parsed(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, titles, headers, lows, highs in parts:
            out = []
            for text, title, keys, lo, hi in zip(texts, titles, headers, lows, highs):
                rows = parse(text, L.Headers(set() if keys is None else set(keys), title), None if pd.isna(lo) else int(lo), None if pd.isna(hi) else int(hi))
                if not with_text:
                    rows = [(r[0], None, *r[2:]) for r in rows if r[2] != L.BLANK and r[2] != L.TABLE]
                out.append(rows)
            yield pd.Series(out)

    return parsed("text", "title", "headers", "page_lo", "page_hi")


def section_lines(sections: DataFrame, books: DataFrame, with_text: bool = False) -> DataFrame:
    """(book_id, section_id, *_LINE), one copy of each section; without text only headers, page numbers and body lines.

    Kept in the checkpoint folder, since word statistics and repair both read it. Texts are shuffled once, by section.
    """
    bounded_arrow_batches(sections.sparkSession)
    once = sections.where("text is not null").select(*_KEY, "text", "page_lo", "page_hi").dropDuplicates(_KEY)
    titles = sized_side(kept(books.groupBy("book_id").agg(F.max("title").alias("title"))))
    headers = sized_side(kept(running_headers(sections.where("text is not null").select("book_id", "text").join(titles, "book_id", "left"))))
    each = once.join(titles, "book_id", "left").join(headers, "book_id", "left").select(*_KEY, F.explode(_parsed(with_text)).alias("x"))
    return kept(each.select(*_KEY, "x.*"))


def word_uses(marked: DataFrame) -> DataFrame:
    """(book_id, section_id, line_no, word, before, after): whole words of body lines with their neighbours there."""
    pairs = F.expr("transform(words, (w, i) -> struct(w as word, get(words, i - 1) as before, get(words, i + 1) as after))")
    return marked.where("kind = 'body'").select(*_KEY, "line_no", F.explode(pairs).alias("x")).select(*_KEY, "line_no", "x.*").where("word rlike '[a-z]'")


def word_forms(marked: DataFrame) -> DataFrame:
    """(word, uses, look, best, best_uses): every form with the most used one of its skeleton. Counted before the shuffle."""
    words = marked.where("kind = 'body'").select(F.explode("words").alias("word")).where("word rlike '[a-z]'")
    forms = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses")).withColumn("look", L.glyphs(F.col("word")))
    clean = ~F.col("word").rlike(_ODD_GLYPH)
    best = forms.groupBy("look").agg(F.max(F.when(clean, F.struct("uses", "word"))).alias("top"))
    return kept(forms.join(merged(best), "look").select("word", "uses", "look", F.col("top.word").alias("best"), F.col("top.uses").alias("best_uses")))


def doubted_forms(forms: DataFrame) -> DataFrame:
    """(word, best, odd, share, letters): forms with a sign inside that no word has (odd), and forms that are rare beside the frequent one of their skeleton."""
    letters = F.length(F.regexp_replace("word", "[^a-z]", ""))
    odd = F.col("word").rlike(_ODD_GLYPH) & ~F.col("word").rlike(_PLAIN_NUMBER) & ~F.col("word").rlike("^(p\\(|https?:|www\\.)|@.*\\.|^@") & (letters >= 2)
    known = (F.col("best") != F.col("word")) | (~F.col("word").rlike("[234]") & (letters >= LETTER_SHARE * F.length("word")))
    rare = (F.col("word") != F.col("best")) & (F.col("uses") <= F.greatest(F.lit(1), F.floor(F.col("best_uses") * RARE_SHARE))) & (F.length("word") >= JUDGED_LETTERS) & (F.col("best_uses") >= 2)
    best = F.when(F.col("best") != F.col("word"), F.col("best"))
    return forms.where((odd & known) | (~odd & rare)).select("word", best.alias("best"), odd.alias("odd"), (F.col("uses") / F.col("best_uses")).alias("share"), F.length("word").alias("letters"))


def misread_forms(marked: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, correct): forms that are misreadings; correct is null where no clean form of the skeleton has the context's support.

    Context is gathered only for doubted forms and the forms they may stand for: the words before and after and the book. Each
    (form, context) is one row however often it occurs, so a frequent form or neighbour is no hot key.
    """
    doubted = kept(doubted_forms(forms))
    asked = kept(doubted.select("word").unionByName(doubted.where("best is not null").select(F.col("best").alias("word"))).distinct())
    around = F.array(F.concat(F.lit("<"), "before"), F.concat(F.lit(">"), "after"), F.concat(F.lit("="), "book_id"))
    contexts = word_uses(marked).join(sized_side(asked), "word").select("word", F.explode(around).alias("context")).where("context is not null").distinct()
    contexts = kept(contexts)
    pairs = doubted.where("best is not null").join(merged(contexts), "word").select("word", "best", "context")
    shared = pairs.join(merged(contexts.select(F.col("word").alias("best"), "context")), ["best", "context"])
    support = shared.groupBy("word").agg(F.max((~F.col("context").startswith("=")).cast("int")).alias("beside"))
    judged = doubted.join(merged(support), "word", "left")
    book = F.col("beside").isNotNull() & (F.col("share") <= BOOK_SHARE) & (F.col("letters") >= BOOK_LETTERS)
    backed = (F.coalesce("beside", F.lit(0)) == 1) | book
    chosen = F.when(backed | (F.col("odd") & F.col("beside").isNotNull()), F.col("best"))
    return kept(judged.where(F.col("odd") | backed).select("word", chosen.alias("correct")))


def broken_words(marked: DataFrame, forms: DataFrame) -> DataFrame:
    """Broken words with what they are: glued (true: the hyphen only breaks the word), word (folded whole form), misread.

    The form seen elsewhere decides: with the hyphen it stays, without it goes; unseen words are glued unless the next part
    begins with a capital, a digit or is a joining word after a suspended hyphen.
    """
    ends = marked.where("next_no is not null and b <> ''").select(*_KEY, "line_no", "next_no", "a", "b", F.col("b").rlike("^[0-9]").alias("digit"))
    looks = ends.withColumn("glued_look", L.glyphs(F.concat("a", "b"))).withColumn("kept_look", L.glyphs(F.concat("a", F.lit("-"), "b")))
    by_look = forms.groupBy("look").agg(F.max(F.struct("uses", "word")).alias("top")).select("look", F.col("top.uses").alias("n"), F.col("top.word").alias("w"))
    g = by_look.select(F.col("look").alias("glued_look"), F.col("n").alias("glued_n"), F.col("w").alias("glued_w"))
    k = by_look.select(F.col("look").alias("kept_look"), F.col("n").alias("kept_n"), F.col("w").alias("kept_w"))
    both = looks.join(merged(g), "glued_look", "left").join(merged(k), "kept_look", "left")
    joiner = F.col("b").isin("en", "of", "and", "or", "und", "oder", "et", "ou", "y", "o", "e", "u")
    unseen = ~F.col("digit") & ~joiner
    glued = F.when(F.col("glued_n").isNull() & F.col("kept_n").isNull(), unseen).otherwise(F.coalesce("glued_n", F.lit(0)) >= F.coalesce("kept_n", F.lit(0)))
    glued = F.when(joiner & F.col("glued_n").isNull(), False).otherwise(glued)
    out = both.withColumn("glued", glued)
    whole = F.when(F.col("glued"), F.concat("a", "b")).otherwise(F.concat("a", F.lit("-"), "b"))
    known = F.when(F.col("glued"), F.col("glued_w")).otherwise(F.col("kept_w"))
    return out.select(*_KEY, "line_no", "next_no", "glued", joiner.alias("suspended"), whole.alias("word"), known.alias("known"), (whole.rlike(_ODD_GLYPH) | (known.isNotNull() & (whole != known) & (F.length(whole) >= JUDGED_LETTERS))).alias("misread"))


@F.pandas_udf(T.StringType())
def _with_fixes(lines: pd.Series, fixes: pd.Series) -> pd.Series:
    """Each word of the line that has a fix, in its place and with its first letter's case."""

    def one(line: str, known: dict) -> str:
        known = dict(known)

        def word(m: re.Match) -> str:
            whole = m.group()
            core = _EDGES.sub("", L.fold(whole))
            if core not in known:
                return whole
            left, right = _LEFT.match(whole).group(), _RIGHT.search(whole).group()
            first = whole[len(left) : len(left) + 1]
            return left + (known[core].capitalize() if first.isupper() else known[core]) + right

        return re.sub("\\S+", word, line)

    return pd.Series([one(a, b) if b is not None else a for a, b in zip(lines, fixes)])


def noise(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, section_id, line_no, noise), one row per damaged line and kind."""
    marked = section_lines(table(spark, folder, "sections"), table(spark, folder, "books").select("book_id", "title"))
    forms = word_forms(marked)
    furniture = marked.where("kind in ('header', 'page_number')").select(*_KEY, "line_no", F.col("kind").alias("noise"))
    broken = broken_words(marked, forms)
    hyphens = broken.where("glued").select(*_KEY, "line_no", F.lit("hyphen").alias("noise"))
    misread = word_uses(marked).join(sized_side(misread_forms(marked, forms)), "word", "left_semi").select(*_KEY, "line_no").distinct()
    split = broken.where("misread").select(*_KEY, F.col("next_no").alias("line_no"))
    ocr = misread.unionByName(split).distinct().withColumn("noise", F.lit("ocr"))
    return furniture.unionByName(hyphens).unionByName(ocr)


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, section_id, repaired): each section as continuous paragraphs.

    Headers and page numbers are gone, broken words whole, misread words replaced by the chosen form (its case follows the
    first letter), lines of a paragraph joined by a space; a paragraph that a page break interrupts goes on. Tables keep their lines.
    """
    marked = section_lines(table(spark, folder, "sections"), table(spark, folder, "books").select("book_id", "title"), with_text=True)
    forms = word_forms(marked)
    bad = misread_forms(marked, forms).where("correct is not null")
    fixes = word_uses(marked).join(sized_side(bad), "word").groupBy(*_KEY, "line_no").agg(F.map_from_entries(F.collect_set(F.struct("word", "correct"))).alias("fixes"))
    glue = broken_words(marked, forms).where("glued or not suspended").select(*_KEY, "line_no", F.lit(True).alias("glue"), "glued")
    kept = marked.where("kind not in ('header', 'page_number')").withColumn("blank", F.col("kind") == "blank").withColumn("table", F.col("kind") == "table").select(*_KEY, "line_no", "line", "blank", "table").join(merged(fixes), [*_KEY, "line_no"], "left").join(merged(glue), [*_KEY, "line_no"], "left").withColumn("glue", F.coalesce("glue", F.lit(False)))
    text = F.when(F.col("fixes").isNotNull(), _with_fixes("line", "fixes")).otherwise(F.col("line"))
    text = F.when(F.col("glued"), F.regexp_replace(text, f"[{_HYPHENS}]\\s*$", "")).otherwise(F.when(F.col("table"), text).otherwise(F.rtrim(text)))
    w = Window.partitionBy(*_KEY).orderBy("line_no")
    shaped = kept.withColumn("out", text).withColumn("gap", F.sum((~F.col("blank")).cast("int")).over(w))
    last = F.last(F.when(~F.col("blank"), F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    prev = F.last(F.when(~F.col("blank"), F.struct("line", "glue", "table", "line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.last(F.when(F.col("blank"), F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    solid = shaped.withColumn("prev", prev).withColumn("cut", cut).withColumn("last", last).where("not blank")
    open_end = ~F.col("prev.line").rlike("[.!?:…。！？।»”\"')\\]]\\s*$")
    new = F.col("prev").isNotNull() & (F.col("cut") > F.col("last")) & ~(open_end & ~F.col("table") & ~F.col("prev.table"))
    sep = F.when(F.col("prev").isNull() | F.col("prev.glue"), "").when(new, "\n\n").when(F.col("table") | F.col("prev.table"), "\n").otherwise(" ")
    parts = solid.select(*_KEY, F.struct("line_no", F.concat(sep, F.col("out")).alias("s")).alias("p"))
    return parts.groupBy(*_KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("repaired"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged lines of all sections."""
    return noise(spark, folder)


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """All sections as continuous, readable paragraphs."""
    return repaired(spark, folder)
