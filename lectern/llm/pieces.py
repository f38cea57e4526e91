"""Problem 2: splitting oversized items at natural boundaries.

Method: a recursive hierarchy of separators: section, paragraph, sentence, word, character. A text within the limit is one unit; a
longer one falls into its paragraphs, a paragraph over the limit into sentences, such a sentence into words, such a word into
characters. Units are packed greedily up to the limit; where the next unit doesn't fit and the piece is not yet half full, the
unit itself is cut at the next finer separator that fits. The next piece begins the stated overlap before the end of the last,
so nothing is lost and the order holds. cut_level is the depth the recursion needs.

Null texts have no piece, empty ones one empty piece; repeated rows count once; positions count characters; extra columns are not
read. The limit and the overlap come from part_limits, else the defaults below.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.sentences import sentence_ends
from lectern.session import bounded_arrow_batches
from lectern.sources.tables import table

DEFAULT_LIMIT, DEFAULT_OVERLAP = 8000, 200
_KEY = ["book_id", "section_id"]
_BLANK = re.compile("\\n[^\\S\\n]*\\n\\s*")
_SPACE = re.compile("\\s+")


LEVELS = ("section", "paragraph", "sentence", "word", "character")


class Boundaries:
    """The places between units of one text, by level."""

    def __init__(self, text: str, sentences: list[int]) -> None:
        self.text = text
        self.points = {"paragraph": [m.end() for m in _BLANK.finditer(text)], "sentence": sorted(sentences), "word": [m.end() for m in _SPACE.finditer(text)]}

    def inside(self, level: str, a: int, b: int) -> list[int]:
        """Places of a level strictly between a and b."""
        points = self.points[level]
        return points[bisect.bisect_right(points, a) : bisect.bisect_left(points, b)]

    def last(self, level: str, a: int, most: int) -> int | None:
        """The last place of a level after a, up to most."""
        points = self.points[level]
        at = bisect.bisect_right(points, most) - 1
        return points[at] if at >= 0 and points[at] > a else None

    def units(self, a: int, b: int, limit: int, depth: int = 0) -> list[tuple[int, int, int]]:
        """(start, end, depth) of the coarsest units within the limit (outer white space aside), in order."""
        if b - a <= limit or len(self.text[a:b].strip()) <= limit:
            return [(a, b, depth)]
        if depth + 1 == len(LEVELS) - 1:
            return [(i, min(i + limit, b), depth + 1) for i in range(a, b, limit)]
        edges = [a, *self.inside(LEVELS[depth + 1], a, b), b]
        return [u for i, j in itertools.pairwise(edges) for u in self.units(i, j, limit, depth + 1)]


def cut_points(text: str, sentences: list[int], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the boundary at the end) of the pieces; the last piece's level is 'end'."""
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("0 <= overlap < limit is needed")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    bounds = Boundaries(text, sentences)
    waiting = bounds.units(0, n, limit)[::-1]
    out, start, end, level = [], 0, 0, "paragraph"
    while waiting:
        a, b, depth = waiting[-1]
        if b - start <= limit:
            waiting.pop()
            end, level = b, LEVELS[max(depth, 1)]
            continue
        if end - start < limit / 2 or end <= start + overlap:  # the unit itself is cut: at the coarsest finer separator that fills half, else as late as one fits
            most, least = start + limit, max(a, start + overlap)
            finer = [(bounds.last(x, least, most), x) for x in LEVELS[depth + 1 : -1]] if depth + 1 < len(LEVELS) - 1 else []
            found = [(p, x) for p, x in finer if p is not None and p < b]
            full = [(p, x) for p, x in found if p - start >= limit / 2]
            if full or end <= start + overlap:
                cut, level = full[0] if full else max(found, default=(most, "character"), key=lambda f: f[0])
                waiting[-1] = (cut, b, depth)
                end = cut
        out.append((start, end, level))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def cut_level(text: str, sentences: list[int], limit: int) -> str:
    """The coarsest boundary that is enough by itself: the depth that separating the text needs."""
    depth = max(d for _, _, d in Boundaries(text, sentences).units(0, len(text), limit))
    return "none" if LEVELS[depth] == "character" else LEVELS[max(depth, 1)]


_PIECES = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("cut", T.StringType())]))


def _pieces(limit: int, overlap: int) -> Column:
    @F.pandas_udf(_PIECES)
    def pieces(texts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([cut_points(t, [] if e is None else [int(x) for x in e], limit, overlap) if isinstance(t, str) else [] for t, e in zip(texts, ends)])

    return pieces("text", "ends")


def _level(limit: int) -> Column:
    @F.pandas_udf(T.StringType())
    def level(texts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([cut_level(t, [] if e is None else [int(x) for x in e], limit) for t, e in zip(texts, ends)])

    return level("text", "ends")


def limits(spark: SparkSession, folder: str, item: str = "sections.text") -> tuple[int, int]:
    """Limit and overlap of an item kind; part_limits has one row per kind, so at most one row is read here."""
    rows = table(spark, folder, "part_limits").where(F.col("item") == item).select("max_chars", "overlap_chars").limit(1).collect()
    return (rows[0][0] or DEFAULT_LIMIT, rows[0][1] or 0) if rows else (DEFAULT_LIMIT, DEFAULT_OVERLAP)


def _oversized(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """Oversized sections, once each, with the ends of their sentences; only these are shuffled with their text."""
    bounded_arrow_batches(spark)
    sections = table(spark, folder, "sections").select(*_KEY, "text")
    large = sections.where(F.length("text") > limit).dropDuplicates(_KEY)
    ends = sentence_ends(sections, table(spark, folder, "books").select("book_id", "title"), large)
    return large.join(ends.groupBy(*_KEY).agg(F.array_sort(F.collect_list("end_pos")).alias("ends")), _KEY, "left")


def split_pieces(spark: SparkSession, folder: str, limit: int, overlap: int) -> DataFrame:
    """(book_id, section_id, piece_no, start_pos, end_pos, cut, piece) of all sections."""
    small = table(spark, folder, "sections").select(*_KEY, "text").where(F.length("text") <= limit).dropDuplicates(_KEY)
    whole = small.select(*_KEY, F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), F.length("text").alias("end_pos"), F.lit("end").alias("cut"), F.col("text").alias("piece"))
    each = _oversized(spark, folder, limit).select(*_KEY, "text", F.posexplode(_pieces(limit, overlap)).alias("piece_no", "p"))
    cut = each.select(*_KEY, "piece_no", "p.start_pos", "p.end_pos", "p.cut", F.substring("text", F.col("p.start_pos") + 1, F.col("p.end_pos") - F.col("p.start_pos")).alias("piece"))
    return whole.unionByName(cut)


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All sections as pieces within the limit."""
    return split_pieces(spark, folder, *limits(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sections over the limit with the depth at which the splitter's recursion ends."""
    limit, _ = limits(spark, folder)
    return _oversized(spark, folder, limit).select(*_KEY, _level(limit).alias("cut_level"))
