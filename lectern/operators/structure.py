"""Document structure: lines and paragraphs of section texts, their cleaning, headings, running lines and statistics.

Texts are taken once per (book_id, section_id); null texts have no lines; positions start at 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

SECTION = ["book_id", "section_id"]
# Headings of exercises and of source lists, blanks to fill in, footnotes, captions and numbering.
EXERCISE = "(?i)^(oefening(en)?|opdracht(en)?|opgave(n)?|vragen|vraag|toets jezelf|test jezelf|zelftoets|exercises?|questions|practice)(\\s+(bij\\s+)?[\\p{L}\\p{N}_.'’-]+){0,6}\\s*[:.]?\\s*$"
REFERENCES = "(?i)^(bronnen|bronvermelding|bronnenlijst|literatuur|literatuurlijst|literatuurverwijzingen|referenties|noten|verder lezen|references|bibliography|further reading|notes)\\s*[:.]?\\s*$"
FILL_IN, FOOTNOTE = "_{4,}|\\.{8,}|…{3,}|\\[\\s*\\]", "^\\s*[*†‡]\\s+\\S"
CAPTION = "(?i)^(figuur|fig\\.|figure|afbeelding|abb\\.|tabel|table|tabelle)\\s*[0-9]+([.][0-9]+)*"
NUMBERING = "(?i)^((hoofdstuk|chapter|kapitel|chapitre)\\s+([0-9]+|[ivxlc]+)\\s*[:.]?\\s+|[0-9]+([.][0-9]+)*[.]?\\s+)"
CLOSED = "[.!?:;’'”\\])]\\s*$"


def texts_once(sections: DataFrame) -> DataFrame:
    return sections.where("text is not null").select(*SECTION, "chapter_id", "section_no", "title", "text").dropDuplicates(SECTION)


def lines(sections: DataFrame) -> DataFrame:
    """(book_id, section_id, line_no, line)."""
    return texts_once(sections).select(*SECTION, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def paragraphs(sections: DataFrame) -> DataFrame:
    """(book_id, section_id, para_no, para, chapter_id, section_no): stretches between blank lines, trimmed, empty ones left out before numbering."""
    kept = F.filter(F.transform(F.split("text", "\\n[ \\t]*\\n"), lambda p: F.trim(p, F.lit(" \n\t"))), lambda p: p != "")
    return texts_once(sections).select(*SECTION, F.posexplode(kept).alias("para_no", "para"), "chapter_id", "section_no")


def rejoined(paras: DataFrame) -> DataFrame:
    """Paragraphs cut in the middle of a sentence made whole: the one before has no closing mark, this one begins in lower case, neither with '['."""
    w = Window.partitionBy(*SECTION).orderBy("para_no")
    before = F.lag("para").over(w)
    goes_on = before.isNotNull() & ~before.startswith("[") & ~F.col("para").startswith("[") & ~before.rlike(CLOSED) & F.col("para").rlike("^\\s*[a-zà-ÿ]")
    islands = paras.withColumn("island", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w))
    ordered = islands.groupBy(*SECTION, "island").agg(F.array_sort(F.collect_list(F.struct("para_no", "para"))).alias("p"))
    return ordered.select(*SECTION, F.col("island").alias("para_no"), F.array_join(F.transform("p", lambda x: x["para"]), " ").alias("para"), F.size("p").alias("parts"))


def cleaned(paras: DataFrame) -> DataFrame:
    """Counts per section of fill-ins, footnotes, exercise and source headings, captions, and what is kept."""
    t = F.col("para")
    kinds = F.when(t.rlike(FILL_IN), "fill_in").when(t.rlike(FOOTNOTE), "footnote").when((F.length(t) <= 80) & F.trim(t).rlike(EXERCISE), "exercise").when((F.length(t) <= 40) & F.trim(t).rlike(REFERENCES), "references").when(F.trim(t).rlike(CAPTION), "caption").otherwise("kept")
    k = paras.withColumn("kind", kinds)
    return k.groupBy(*SECTION).agg(*[F.count_if(F.col("kind") == x).alias(x) for x in ("fill_in", "footnote", "exercise", "references", "caption", "kept")], F.coalesce(F.sum(F.when(F.col("kind") == "kept", F.length(t))), F.lit(0)).alias("kept_chars"))


def heading_like(all_lines: DataFrame) -> DataFrame:
    """Lines shaped like a heading, with the numbering taken off: up to 120 characters and 14 words, not digits only, no trailing mark."""
    t = F.trim(F.col("line"))
    n = F.size(F.split(t, "\\s+"))
    shape = (t != "") & (F.length(t) <= 120) & (n <= 14) & ~t.rlike("^[0-9.\\s]+$") & ~t.rlike("[,;:]$") & (~t.endswith(".") | t.rlike(NUMBERING))
    return all_lines.where(shape).select(*SECTION, "line_no", F.coalesce(F.nullif(F.trim(F.regexp_replace(t, NUMBERING, "")), F.lit("")), t).alias("heading"))


def running_lines(all_lines: DataFrame, share: float = 0.3) -> DataFrame:
    """Short lines that, digits masked, stand in many sections of a book (at least two and the share of its sections)."""
    keyed = all_lines.where("trim(line) <> '' and length(line) <= 80").select("book_id", "section_id", F.regexp_replace(F.lower(F.trim("line")), "[0-9]+", "#").alias("key"))
    total = all_lines.groupBy("book_id").agg(F.count_distinct("section_id").alias("sections"))
    n = keyed.distinct().groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("in_sections"))
    return n.join(total, "book_id").where((F.col("in_sections") >= 2) & (F.col("in_sections") >= share * F.col("sections"))).select("book_id", "key", "in_sections")


def joined_lines(paras: DataFrame) -> DataFrame:
    """Printed lines of each paragraph as one line; a hyphen between letters at a line's end goes if the next line begins in lower case."""
    glued = F.regexp_replace("para", "(\\p{L})-\\n(\\p{Ll})", "$1$2")
    return paras.select(*SECTION, "para_no", F.regexp_replace(glued, "\\s*\\n\\s*", " ").alias("para"))


def section_profile(sections: DataFrame) -> DataFrame:
    """Characters, words, formula density, dense or not, guessed language, numbers and sentences of each section."""
    t = F.col("text")
    density = X.formula_density(t)
    return texts_once(sections).select(*SECTION, F.length(t).alias("chars"), X.word_count(t).alias("words"), density.alias("density"), (density >= 0.02).alias("dense"), X.language_guess(t).alias("guess"), F.regexp_count(t, F.lit("[0-9]+([.,][0-9]+)?")).alias("numbers"))


def chapter_profile(sections: DataFrame) -> DataFrame:
    """Per chapter: sections, characters, pages, and the chapters before and after it; books of 2 to 120 chapters with a median of 600 characters are well cut."""
    once = sections.select("book_id", "chapter_id", "section_id", F.length("text").alias("n"), "page_lo", "page_hi").dropDuplicates(SECTION)
    c = once.groupBy("book_id", "chapter_id").agg(F.count(F.lit(1)).alias("sections"), F.coalesce(F.sum("n"), F.lit(0)).alias("chars"), F.min("page_lo").alias("page_lo"), F.max("page_hi").alias("page_hi"))
    w = Window.partitionBy("book_id").orderBy("chapter_id")
    return c.select("*", F.lag("chapter_id").over(w).alias("before"), F.lead("chapter_id").over(w).alias("after"))


def well_cut_books(chapters: DataFrame) -> DataFrame:
    b = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.median("chars").alias("median_chars"))
    return b.select("*", (F.col("chapters").between(2, 120) & (F.col("median_chars") >= 600)).alias("well_cut"))
