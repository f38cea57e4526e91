"""Problem 7: held-out test items inside training documents.

Method: Wu-Manber multi-pattern search. Every item is cut into word blocks such that any twelve words in a row hold a whole block
and any whole item with four words changed keeps one block intact. A shift table over character blocks skips positions where no
pattern can end, a hash of the last character block selects the patterns to compare, and direct comparison confirms: the words
around a hit are counted until they differ (a run of twelve is a leak; every separate run of an alignment is counted), else the
whole item is laid over the place and its differing words counted, once per alignment.

What an item's block finds in a text depends on that item only; of overlapping finds in a document the ones with fewest changes
stay, and that is decided over all items. So the blocks of items in which the search goes change nothing but its memory.

Case, accents, punctuation and white space don't matter. Null and empty texts and items match nothing; documents are read once
for every SHIPPED_CHARS of items (once for some hundred thousand items), never shuffled; repeated rows count once; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import bounded_arrow_batches
from lectern.sources.tables import table

RUN_WORDS, CHANGED_WORDS = 12, 4
#: Items whose tables a worker holds at a time, and characters of items that are broadcast at a time.
ITEM_BLOCK, SHIPPED_CHARS = 2000, 64_000_000
_GAPS = re.compile("[\\W_]+")
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff]+")


def words_of(text: str) -> list[str]:
    """Folded words."""
    return normal(text).split()


def normal(text: str) -> str:
    """Folded words between single spaces, with a space at either end."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return f" {_GAPS.sub(' ', text.lower()).strip()} "


class Machine:
    """Shift table, suffix buckets and patterns of one group of patterns."""

    def __init__(self, patterns: dict[str, list[tuple[int, int]]], block: int) -> None:
        self.least = min(map(len, patterns))
        self.block = min(block, self.least)
        self.default = self.least - self.block + 1
        self.shift: dict[str, int] = {}
        self.buckets: dict[str, list[tuple[str, list[tuple[int, int]]]]] = defaultdict(list)
        for pattern, owners in patterns.items():
            for end in range(self.block, self.least + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), self.least - end)
            self.buckets[pattern[self.least - self.block : self.least]].append((pattern, owners))

    def search(self, text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(start, owners) of every pattern occurrence."""
        shift, block, default, least, at, n = self.shift.get, self.block, self.default, self.least, self.least, len(text)
        while at <= n:
            key = text[at - block : at]
            skip = shift(key, default)
            if skip:
                at += skip
                continue
            for pattern, owners in self.buckets[key]:
                if text.startswith(pattern, at - least):
                    yield at - least, owners
            at += 1


#: What is found in one text: (item, words that differ, first word, word after the last). An exact run has none that differ.
Find = tuple[int, int, int, int]


class Items:
    """The items' words and the machines that find their blocks."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.words = {i: words_of(t) for i, t in items if isinstance(t, str) and words_of(t)}
        long: dict[str, list[tuple[int, int]]] = defaultdict(list)
        short: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, x in self.words.items():
            size = max(1, min((RUN_WORDS + 1) // 2, len(x) // (CHANGED_WORDS + 1)))
            starts = range(0, len(x) - size + 1, size)
            for at in starts:
                pattern = f" {' '.join(x[at : at + size])} "
                (long if len(pattern) >= 20 else short)[pattern].append((i, at))
        self.machines = [Machine(p, b) for p, b in ((long, 6), (short, 4)) if p]

    def finds(self, shown: str) -> list[Find]:
        """What a text in normal form holds of each item."""
        out: list[Find] = []
        words: list[str] = []
        sure: set[int] = set()
        tried: set[tuple[int, int]] = set()
        for machine in self.machines:
            # End of the last compared run per alignment; hits come in the order of the text within one machine only.
            compared: dict[tuple[int, int], int] = {}
            for start, owners in machine.search(shown):
                if not words:
                    words = shown.split()
                index = shown.count(" ", 0, start)
                for item, at in owners:
                    place = (item, index - at)
                    if item in sure or index < compared.get(place, 0):
                        continue
                    own = self.words[item]
                    low, high = 0, 0
                    while at - low > 0 and index - low > 0 and own[at - low - 1] == words[index - low - 1]:
                        low += 1
                    while at + high < len(own) and index + high < len(words) and own[at + high] == words[index + high]:
                        high += 1
                    if low + high >= RUN_WORDS or low + high == len(own):
                        sure.add(item)
                        out.append((item, 0, index - low, index + high))
                        continue
                    compared[place] = index + high
                    if place in tried:
                        continue
                    tried.add(place)
                    begin = index - at
                    if begin < 0 or begin + len(own) > len(words):
                        continue
                    changed = 0
                    for w, x in zip(own, words[begin : begin + len(own)]):
                        changed += w != x
                        if changed > CHANGED_WORDS:
                            break
                    else:
                        out.append((item, changed, begin, begin + len(own)))
        return out


def settled(finds: list[Find]) -> list[int]:
    """Items that stay: an altered copy gives way to a find with fewer changes that shares words with it, as items share their frames."""
    taken: list[tuple[int, int, int]] = []
    out: set[int] = set()
    for changed, item, begin, end in sorted((c, i, a, b) for i, c, a, b in finds):
        if not any(begin < e and b < end and c < changed for c, b, e in taken):
            taken.append((changed, begin, end))
            out.add(item)
    return sorted(out)


_FINDS = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("changed", "first", "after")]]))


def _found(shared):
    """What every text holds of the items broadcast: items come as text, and the tables of one block of them at a time are built from it."""

    @F.pandas_udf(_FINDS)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = shared.value
        blocks = range(0, len(items), ITEM_BLOCK)
        only = Items(items) if len(blocks) == 1 else None
        for part in parts:
            shown = [normal(t) if isinstance(t, str) else " " for t in part]
            out: list[list[Find]] = [[] for _ in shown]
            for start in blocks:
                block = only or Items(items[start : start + ITEM_BLOCK])
                for rows, text in zip(out, shown):
                    rows.extend(block.finds(text))
            yield pd.Series(out)

    return found


@F.pandas_udf(T.ArrayType(T.LongType()))
def _settled(finds: pd.Series) -> pd.Series:
    return finds.map(lambda rows: settled([(r["item"], r["changed"], r["first"], r["after"]) for r in rows]))


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> (doc_id, item_id)."""
    spark = documents.sparkSession
    numbered = items.where("text is not null").select("item_id", "text").dropDuplicates(["item_id"])
    rows, chars = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    # Beyond one block, larger batches of texts spread the cost of building a block's tables.
    bounded_arrow_batches(spark, 256 if rows <= ITEM_BLOCK else 4096)
    shipments = -(-chars // SHIPPED_CHARS) or 1
    shipped = numbered.withColumn("shipment", F.pmod(F.xxhash64("item_id"), F.lit(shipments)))
    finds = []
    for number in range(shipments):
        own = sorted(tuple(r) for r in shipped.where(F.col("shipment") == number).select("item_id", "text").collect())  # about SHIPPED_CHARS
        finds.append(_found(spark.sparkContext.broadcast(own))("text"))
    each = documents.where("text is not null").select("doc_id", F.concat(*finds).alias("finds")).where("size(finds) > 0")
    return each.select("doc_id", F.explode(_settled("finds")).alias("item_id")).distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a document and a test item it holds."""
    return find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "quiz_items"))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Per test item: how many documents hold it, of how many sources."""
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return p7_found(spark, folder).join(documents, "doc_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"))
