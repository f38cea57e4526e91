"""Cutting a book into chapters and sections: an ordered stream of printed units, its headings, zones that are left out, paragraphs.

units(book_id, idx, page, kind, text, size, bold, block_id): idx orders a book's units from 0; kind is line, figure or table.
Repeated units (same book and idx) must be taken out before. Null texts are empty; a book without units has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.structure import EXERCISE, REFERENCES
from lectern.session import kept

# Shapes of numbered headings, and the sizes and lengths that decide.
H1_WORD = "(?iu)^(hoofdstuk|chapter|deel|part|les|module)\\s+([0-9]{1,3}|[ivxlc]{1,6})(?![\\p{L}\\p{N}_])[:.]?\\s*(.*)$"
H1_PLAIN, H2, H3 = "^([0-9]{1,2})[.:]?\\s+(\\S.*)$", "^([0-9]{1,2})\\.([0-9]{1,2})[.:]?\\s+(\\S.*)$", "^([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{1,2})[.:]?\\s+(\\S.*)$"
PREFIX = "(?iu)^((hoofdstuk|chapter|deel|part|les|module)\\s+)?([0-9]{1,3}(\\.[0-9]{1,3}){0,2}|[ivxlc]{1,6})[.:]?\\s+"
DEFAULT_SIZE, BIG, FIRST_LEVEL, SAME_SIZE, MERGED_SIZE = 10.0, 1.15, 1.3, 0.25, 0.3
LEAST_CHAPTER, LEAST_FRONT = 300, 200


def _order() -> Window:
    return Window.partitionBy("book_id").orderBy("idx")


def body_sizes(units: DataFrame) -> DataFrame:
    """(book_id, body): the size, rounded to halves, in which most characters of a book are printed; the first seen on a tie."""
    lines = units.where("kind = 'line'").groupBy("book_id", (F.bround(F.col("size") * 2) / 2).alias("rounded")).agg(F.sum(F.length("text")).alias("chars"), F.min("idx").alias("first"))
    known = lines.where("rounded is not null").groupBy("book_id").agg(F.max_by("rounded", F.struct("chars", -F.col("first"))).alias("body"))
    return units.select("book_id").distinct().join(known, "book_id", "left").select("book_id", F.coalesce("body", F.lit(DEFAULT_SIZE)).alias("body"))


def clean_title(text: Column) -> Column:
    """A heading without its number; the heading itself if nothing is left."""
    shown = F.trim(text)
    cut = F.trim(F.regexp_replace(shown, PREFIX, ""))
    return F.when(cut != "", cut).otherwise(shown)


def _heading_shape(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, "[\\s\\p{Z}]+"), lambda w: w != ""))
    return (words > 0) & (F.length(text) <= 120) & (words <= 14) & ~text.rlike("^[\\p{Nd}.\\s]+$") & ~text.rlike("[,;:]$") & (~text.endswith(".") | text.rlike(PREFIX))


def headings(units: DataFrame) -> DataFrame:
    """(book_id, idx, page, level, text, size, span): headings by number, size and weight; lines of one heading are merged.

    Numbered headings have the level of their number; other big lines get that of the numbered headings of their size, else of the largest size.
    """
    t = units.join(body_sizes(units), "book_id").withColumn("in_block", F.count_if(F.col("kind") == "line").over(Window.partitionBy("book_id", "block_id")))
    text = F.col("text")
    big, strong = F.col("size") >= F.col("body") * BIG, F.coalesce(F.col("bold"), F.lit(False))
    words = F.size(F.filter(F.split(text, "[\\s\\p{Z}]+"), lambda w: w != ""))
    level = (
        F.when(text.rlike(H3), None).when(text.rlike(H1_WORD) & (big | strong), 1).when(text.rlike(H2) & (big | strong), 2).when(text.rlike(H1_PLAIN) & (big | strong), 1)
        .when(big, 0).when(strong & (F.col("size") >= F.col("body")) & (words <= 8) & (F.col("in_block") == 1), 2)
    )
    shaped = t.where(F.col("kind") == "line").where(_heading_shape(text)).withColumn("level", level).where("level is not null")
    book = Window.partitionBy("book_id")
    of = lambda f, n: f(F.when(F.col("level") == n, F.col("size"))).over(book)
    sized = shaped.withColumn("least_1", of(F.min, 1)).withColumn("most_2", of(F.max, 2)).withColumn("most_0", of(F.max, 0))
    first = (F.col("size") >= F.col("most_0") - SAME_SIZE) & (F.col("size") >= F.col("body") * FIRST_LEVEL)
    decided = F.when(F.col("size") >= F.col("least_1") - SAME_SIZE, 1).when(F.col("size") <= F.col("most_2") + SAME_SIZE, 2).when(first, 1).otherwise(2)
    c = sized.withColumn("level", F.when(F.col("level") == 0, decided).otherwise(F.col("level")))
    # Lines of one heading: consecutive units, compared with the first of them, so the list of a book is folded in order.
    listed = c.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("idx", "page", "level", "text", F.col("size").cast("double").alias("size"), F.lit(1).alias("span"), F.col("text").rlike(PREFIX).alias("numbered")))).alias("cs"))
    goes_on = lambda p, x: (p["level"] == x["level"]) & (p["page"] == x["page"]) & (F.abs(p["size"] - x["size"]) < MERGED_SIZE) & (x["idx"] == p["idx"] + p["span"]) & ~x["numbered"]
    kind = "array<struct<idx:int,page:int,level:int,text:string,size:double,span:int,numbered:boolean>>"

    def step(a: Column, x: Column) -> Column:
        p = F.try_element_at(a, F.lit(-1))
        joined = F.struct(p["idx"].alias("idx"), p["page"].alias("page"), p["level"].alias("level"), F.concat(p["text"], F.lit(" "), x["text"]).alias("text"), p["size"].alias("size"), (p["span"] + 1).alias("span"), p["numbered"].alias("numbered"))
        return F.when(p.isNotNull() & goes_on(p, x), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(x)))

    merged = listed.select("book_id", F.explode(F.aggregate(F.col("cs").cast(kind), F.array().cast(kind), step)).alias("h"))
    return merged.select("book_id", "h.idx", "h.page", "h.level", "h.text", "h.size", "h.span")


def zone_of(text: Column) -> Column:
    """'exercises' or 'references' for a heading that opens a zone that is left out, else null."""
    shown = F.trim(text)
    return F.when((F.length(text) <= 80) & shown.rlike(EXERCISE), "exercises").when((F.length(text) <= 40) & shown.rlike(REFERENCES), "references")


def cut_units(units: DataFrame, heads: DataFrame) -> DataFrame:
    """Each unit with chapter_no (0: before the first chapter), section_no (running over the book), zone (null: kept), heading and title.

    A heading of level 1 opens a chapter, any heading a section. A zone begins at its heading, or at a line of that form that is
    bold or alone in its block, and ends at the next real heading.
    """
    h = heads.select("book_id", "idx", F.col("level").alias("h_level"), F.col("text").alias("h_text"), F.col("span").alias("h_span"))
    u = units.join(h, ["book_id", "idx"], "left").withColumn("in_block", F.count_if(F.col("kind") == "line").over(Window.partitionBy("book_id", "block_id")))
    u = u.withColumn("h_zone", F.when(F.col("h_text").isNotNull(), F.coalesce(zone_of(clean_title(F.col("h_text"))), zone_of(F.col("h_text")))))
    under = F.last(F.when(F.col("h_text").isNotNull(), F.col("idx") + F.when(F.col("h_zone").isNotNull(), F.greatest(F.lit(1), F.col("h_span"))).otherwise(F.col("h_span"))), ignorenulls=True).over(_order())
    u = u.withColumn("covered", F.coalesce(F.col("idx") < under, F.lit(False)))
    real = F.col("h_text").isNotNull() & F.col("h_zone").isNull()
    line_zone = F.when((F.col("kind") == "line") & F.col("h_text").isNull() & ~F.col("covered") & (F.coalesce(F.col("bold"), F.lit(False)) | (F.col("in_block") == 1)), zone_of(F.col("text")))
    u = u.withColumn("real", real).withColumn("part", F.sum(F.col("h_text").isNotNull().cast("int")).over(_order())).withColumn("z", F.coalesce("h_zone", line_zone))
    u = u.withColumn("zone", F.first("z", ignorenulls=True).over(Window.partitionBy("book_id", "part").orderBy("idx")))
    # A zone that a heading opens goes on over later zone headings; only a real heading ends it, and each opens a new part.
    chapter = F.sum((F.col("real") & (F.col("h_level") == 1)).cast("int")).over(_order())
    section = F.sum(F.col("real").cast("int")).over(_order())
    return u.withColumn("chapter_no", chapter).withColumn("section_no", section).withColumn("title", F.when(F.col("real"), clean_title(F.col("h_text")))).drop("z", "part", "in_block")


def cut_paragraphs(cut: DataFrame) -> DataFrame:
    """(book_id, chapter_no, section_no, para_no, para, page_lo, page_hi, figures, tables): kept units; lines of one block are one paragraph."""
    shown = cut.where("zone is null and not covered")
    w = Window.partitionBy("book_id", "section_no").orderBy("idx")
    new = (F.col("kind") != "line") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != "line") | ~F.col("block_id").eqNullSafe(F.lag("block_id").over(w))
    numbered = shown.withColumn("para_no", F.sum(new.cast("int")).over(w))
    rows = numbered.groupBy("book_id", "chapter_no", "section_no", "para_no").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("t")))).alias("rows"), F.min("page").alias("page_lo"), F.max("page").alias("page_hi"), F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if(F.col("kind") == "table").alias("tables"))
    joined = F.array_join(F.transform("rows", lambda r: r["t"]), "\n")
    glued = F.regexp_replace(joined, "(\\p{L})-\\n(\\p{Ll})", "$1$2")
    return rows.select("book_id", "chapter_no", "section_no", "para_no", F.regexp_replace(glued, "\\s*\\n\\s*", " ").alias("para"), "page_lo", "page_hi", "figures", "tables")


def book_sections(units: DataFrame, titles: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """units, titles(book_id, title) -> (book_id, chapter_id, chapter_title, level, section_id, section_title, text, page_lo, page_hi, figures, tables, formula_density).

    A chapter shorter than LEAST_CHAPTER joins the last long one before it, its untitled sections taking its title; without one it is
    front matter (ch00), which goes if shorter than LEAST_FRONT. Chapters are numbered ch01 on, sections 1 on within them; a book
    without chapters is one, ch01, under the book's title.
    """
    units = kept(units)
    cut = kept(cut_units(units, headings(units) if heads is None else heads))
    opened = cut.where("real").select("book_id", "section_no", "chapter_no", "title", "h_level")
    paras = cut_paragraphs(cut)
    s = paras.groupBy("book_id", "chapter_no", "section_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "para"))), lambda p: p["para"]), "\n\n").alias("text"), F.sum(F.length("para")).alias("chars"),
        F.min("page_lo").alias("page_lo"), F.max("page_hi").alias("page_hi"), F.sum("figures").alias("figures"), F.sum("tables").alias("tables"),
    )
    chapters = opened.where("h_level = 1").select("book_id", "chapter_no", F.col("title").alias("chapter_title"))
    before = s.where("chapter_no = 0").select("book_id", "chapter_no", F.lit(None).cast("string").alias("chapter_title")).distinct()
    sizes = s.groupBy("book_id", "chapter_no").agg(F.sum("chars").alias("chapter_chars"))
    c = chapters.unionByName(before).join(sizes, ["book_id", "chapter_no"], "left").na.fill(0, ["chapter_chars"])
    long = (F.col("chapter_no") > 0) & (F.col("chapter_chars") >= LEAST_CHAPTER)
    w = Window.partitionBy("book_id").orderBy("chapter_no")
    c = c.withColumn("home", F.last(F.when(long, F.col("chapter_no")), ignorenulls=True).over(w)).withColumn("level", F.when(long, 1).when(F.col("home").isNotNull(), 1).otherwise(0))
    c = c.withColumn("home", F.coalesce("home", "chapter_no"))
    homes = c.groupBy("book_id", "home").agg(F.sum("chapter_chars").alias("home_chars"), F.min_by("chapter_title", "chapter_no").alias("home_title"), F.min("level").alias("level"))
    homes = homes.where(f"level = 1 or home_chars >= {LEAST_FRONT}")
    real_no = F.sum("level").over(Window.partitionBy("book_id").orderBy("home"))
    homes = homes.withColumn("real_no", real_no).withColumn("chapters", F.sum("level").over(Window.partitionBy("book_id")))
    homes = homes.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("home")))
    only = (F.col("chapters") == 0) & (F.col("place") == 1)
    front = F.coalesce("home_title", F.lit("Voorwerk"))
    homes = homes.join(titles.groupBy("book_id").agg(F.max("title").alias("book_title")), "book_id", "left")
    homes = homes.withColumn("final_title", F.when(only & (front == "Voorwerk"), F.coalesce("book_title", front)).otherwise(front)).withColumn("chapter_id", F.when(only, "ch01").when(F.col("level") == 0, "ch00").otherwise(F.format_string("ch%02d", F.col("real_no")))).withColumn("final_level", F.when(only, 1).otherwise(F.col("level")))
    full = s.where(F.trim("text") != "").join(c.select("book_id", "chapter_no", "home", "chapter_title"), ["book_id", "chapter_no"]).join(homes.select("book_id", "home", "final_title", "final_level", "chapter_id"), ["book_id", "home"])
    own = opened.select("book_id", "section_no", F.when(F.col("h_level") != 1, F.col("title")).alias("own_title"))
    full = full.join(own, ["book_id", "section_no"], "left").withColumn("k", F.row_number().over(Window.partitionBy("book_id", "home").orderBy("section_no")))
    titled = F.coalesce("own_title", F.when(F.col("chapter_no") != F.col("home"), F.col("chapter_title")), F.when(F.col("k") == 1, F.col("final_title")), F.concat("final_title", F.lit(" ("), F.col("k").cast("string"), F.lit(")")))
    return full.select(
        "book_id", "chapter_id", F.col("final_title").alias("chapter_title"), F.col("final_level").alias("level"), F.concat("chapter_id", F.lit("."), F.col("k").cast("string")).alias("section_id"), titled.alias("section_title"), "text",
        "page_lo", "page_hi", "figures", "tables", X.formula_density(F.col("text")).alias("formula_density"),
    )


def units_of(sections: DataFrame) -> DataFrame:
    """A stream of units as a book of these sections would be printed: chapter and section headings, then the lines of each paragraph.

    Takes one copy of each section; sections without text have their headings only.
    """
    once = sections.select("book_id", "chapter_id", "section_id", "section_no", "title", "text", "page_lo").dropDuplicates(["book_id", "section_id"])
    place = Window.partitionBy("book_id", "chapter_id").orderBy("section_no", "section_id")
    s = once.withColumn("nth", F.row_number().over(place))
    chapter_head = F.when(F.col("nth") == 1, F.struct(F.concat(F.lit("Hoofdstuk "), F.regexp_extract("chapter_id", "([0-9]+)", 1).cast("int").cast("string")).alias("text"), F.lit(18.0).alias("size"), F.lit(True).alias("bold"), F.lit(-2).alias("para")))
    section_head = F.struct(F.concat(F.regexp_extract("chapter_id", "([0-9]+)", 1).cast("int").cast("string"), F.lit("."), F.col("nth").cast("string"), F.lit(" "), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Deel"))).alias("text"), F.lit(14.0).alias("size"), F.lit(True).alias("bold"), F.lit(-1).alias("para"))
    paras = F.filter(F.split(F.coalesce("text", F.lit("")), "\\n[ \\t]*\\n"), lambda p: F.trim(p, F.lit(" \n\t")) != "")
    lines = F.flatten(F.transform(paras, lambda p, i: F.transform(F.split(p, "\n"), lambda x: F.struct(x.alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), i.alias("para")))))
    each = s.select("book_id", "chapter_id", "section_no", "section_id", F.coalesce("page_lo", F.lit(1)).alias("page"), F.posexplode(F.concat(F.array_compact(F.array(chapter_head)), F.array(section_head), lines)).alias("at", "u"))
    order = Window.partitionBy("book_id").orderBy("chapter_id", "section_no", "section_id", "at")
    changed = ~F.struct("section_id", "u.para").eqNullSafe(F.lag(F.struct("section_id", "u.para")).over(order))
    flat = each.withColumn("idx", F.row_number().over(order) - 1).withColumn("new", changed.cast("int"))
    block = F.sum("new").over(Window.partitionBy("book_id").orderBy("idx"))
    return flat.select("book_id", "idx", "page", F.lit("line").alias("kind"), F.col("u.text").alias("text"), F.col("u.size").alias("size"), F.col("u.bold").alias("bold"), block.cast("int").alias("block_id"))
