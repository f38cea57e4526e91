"""Pronunciation lexicon: merge, order, candidates, replacement. Surfaces are compared in lower case without outer spaces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Notations that are read out in a special way.
CANDIDATES = {
    "dotted": "\\b((?:[A-Za-z]{1,3}\\.){2,})", "short": "(?i)\\b((?:bijv|bv|ca|enz|resp|zgn|nl|vs|etc|afk|ong|max|min|incl|excl)\\.)", "acronym": "\\b([A-Z][A-Z0-9]{1,6})\\b",
    "decimal": "([0-9]+[.,][0-9]+)", "percent": "([0-9]+ ?%)", "fraction": "\\b([0-9]+/[0-9]+)\\b", "sign": "([=<>≤≥≈±√∑∫])", "unit": "\\b([0-9]+(?:[.,][0-9]+)? ?(?:km|cm|mm|kg|mg|ms|kHz|MHz|Hz|kJ|kW|kPa|Pa|mol|°C))\\b",
}


def entries(raw: DataFrame) -> DataFrame:
    """Distinct rows with their key."""
    return raw.distinct().withColumn("key", F.lower(F.trim("surface"))).where("key <> ''")


def merged(raw: DataFrame) -> DataFrame:
    """One entry per book and key. Locked entries win over unlocked ones, then those with a chapter, the earliest chapter first; ties by spoken and surface."""
    best = F.row_number().over(Window.partitionBy("book_id", "key").orderBy(F.coalesce("lock", F.lit(False)).desc(), F.col("source_chapter").isNull(), "source_chapter", "spoken", "surface"))
    return entries(raw).withColumn("nth", best).where("nth = 1").select("book_id", "key", F.trim("surface").alias("surface"), "spoken", F.coalesce("lock", F.lit(False)).alias("locked"))


def in_order(merged_: DataFrame) -> DataFrame:
    """Order of replacement: longest surface first, then by key."""
    return merged_.select("book_id", "key", F.row_number().over(Window.partitionBy("book_id").orderBy(F.length("surface").desc(), "key")).alias("place"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(book_id, key, spoken, locked, change): new surfaces inserted; an unlocked entry gives way to a locked one that is spoken differently; locked entries never change."""
    o, n = old.select("book_id", "key", F.col("spoken").alias("old_spoken"), F.col("locked").alias("old_locked")), new.select("book_id", "key", F.col("spoken").alias("new_spoken"), F.col("locked").alias("new_locked"))
    change = F.when(F.col("old_spoken").isNull(), "inserted").when(~F.col("old_locked") & F.col("new_locked") & (F.col("old_spoken") != F.col("new_spoken")), "overwritten").otherwise("kept")
    j = o.join(n, ["book_id", "key"], "full_outer").withColumn("change", change)
    take_new = F.col("change") != "kept"
    return j.select("book_id", "key", F.when(take_new, F.col("new_spoken")).otherwise(F.col("old_spoken")).alias("spoken"), F.when(take_new, F.col("new_locked")).otherwise(F.col("old_locked")).alias("locked"), "change")


def candidates(texts: DataFrame, limit: int = 60) -> DataFrame:
    """(book_id, section_id, kind, form, place): the first distinct forms of each kind in a text, at most limit a kind (the cap is part of the operator)."""
    found = [F.struct(F.lit(k).alias("kind"), F.slice(F.array_distinct(F.expr("regexp_extract_all(text, r'" + p + "', 1)")), 1, limit).alias("forms")) for k, p in CANDIDATES.items()]
    each = texts.select("book_id", "section_id", F.explode(F.array(*found)).alias("x"))
    return each.select("book_id", "section_id", "x.kind", F.posexplode("x.forms").alias("place", "form"))


def applied(texts: DataFrame, merged_: DataFrame) -> DataFrame:
    """texts(book_id, ..., text) with ``spoken``: every surface replaced in one pass, longest first, whole words, a leading capital kept.

    A book's dictionary travels once per group of its texts: texts are joined with an array of the book's entries by book_id, so nothing is broadcast.
    """
    books = merged_.groupBy("book_id").agg(F.collect_list(F.struct("key", "spoken")).alias("entries"))

    @F.pandas_udf(T.StringType())
    def spoken(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, tuple[re.Pattern, dict[str, str]]] = {}
        for books_, texts_, entries_ in parts:
            out = []
            for book, text, rows in zip(books_, texts_, entries_):
                if not isinstance(text, str) or rows is None or len(rows) == 0:
                    out.append(text)
                    continue
                if book not in known:
                    table = {r["key"]: r["spoken"] for r in rows}
                    known[book] = (re.compile("(?<!\\w)(" + "|".join(re.escape(k) for k in sorted(table, key=lambda k: (-len(k), k))) + ")(?!\\w)", re.IGNORECASE), table)
                pattern, table = known[book]

                def one(m: re.Match, table: dict[str, str] = table) -> str:
                    new = table.get(m.group().lower(), m.group())
                    return new[:1].upper() + new[1:] if m.group()[:1].isupper() and (len(m.group()) == 1 or not m.group().isupper()) else new

                out.append(pattern.sub(one, text))
            yield pd.Series(out)

    return texts.join(books, "book_id", "left").withColumn("spoken", spoken("book_id", "text", "entries")).drop("entries")
