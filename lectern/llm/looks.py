"""Problem 5: visually identical text with different characters.

``unify_text`` brings texts to one form, ``disguises`` names what was changed, ``same_look_groups`` groups the originals
that look the same by equal confusables skeleton.

Nulls stay null and have no disguise; an empty text has none; repeated rows count once; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import scripts as S
from lectern.session import bounded_arrow_batches, kept, merged, sized_side
from lectern.sources.tables import table

KINDS = ("compat", "combining", "invisible", "space", "lookalike")


def _ranges(chars: str) -> str:
    """The characters as the body of a class, neighbours as ranges: Java tests a class range by range."""
    out, codes = [], sorted(set(map(ord, chars)))
    while codes:
        n = next((i for i, c in enumerate(codes) if c != codes[0] + i), len(codes))
        out.append(f"\\x{{{codes[0]:x}}}-\\x{{{codes[n - 1]:x}}}")
        codes = codes[n:]
    return "".join(out)


_PLAIN, _FOREIGN = _ranges(S.INVISIBLE + S.SPACES + "".join(S.COMPAT)), _ranges("".join(S.PROTOTYPES))
#: What any disguise needs at least: a character of the other kinds, or a look-alike beside a Latin letter. Lets the JVM skip all
#: other texts; the cheap class before it spares the rest of the pattern for most characters.
SUSPECT = f"[^\\t\\n -~](?:(?<=[{_PLAIN}{S.MARKS}])|(?<=[{_FOREIGN}])(?=[A-Za-zÀ-ɏḀ-ỿ])|(?<=[A-Za-zÀ-ɏḀ-ỿ][{_FOREIGN}]))"


def disguise_kinds(text: str) -> list[str]:
    """The kinds of disguise in one text, in the order of KINDS: the steps on the way to its skeleton that change it."""
    changed, before = set(), text
    for kind, after in S.skeleton_steps(text):
        if after != before:
            changed.add(kind)
        before = after
    return [k for k in KINDS if k in changed]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _kinds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: disguise_kinds(t) if isinstance(t, str) else [])


@F.pandas_udf(T.StringType())
def _unified(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: S.one_form(t) if isinstance(t, str) else None)


@F.pandas_udf(T.StringType())
def _skeleton(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: S.skeleton(t) if isinstance(t, str) else None)


def unify_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the unified text as column out (null where the text is null)."""
    return df.withColumn(out, F.when(F.col(column).rlike(SUSPECT), _unified(column)).otherwise(F.col(column)))


def skeleton_of(column: str) -> Column:
    """Skeleton as a column; null stays null."""
    return _skeleton(F.col(column))


def same_look_groups(df: DataFrame, column: str) -> DataFrame:
    """One row per distinct text that shares its skeleton with another: its class (hash of the skeleton), uses and the class's size.

    Only hashes are grouped: texts of plain characters are their own skeleton and never leave the JVM. Copies are counted before
    the shuffle by skeleton, so they never meet in one task as rows; class sizes are an aggregate joined back. Only texts of
    classes with several forms are then read and shuffled.
    """
    texts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("form"))
    own = F.sha2("form", 256)
    plain = texts.where(~F.col("form").rlike("[^\\x00-\\x7f]")).select(own.alias("id"), own.alias("look"))
    other = texts.where(F.col("form").rlike("[^\\x00-\\x7f]")).select(own.alias("id"), F.sha2(_skeleton("form"), 256).alias("look"))
    uses = plain.unionByName(other).groupBy("look", "id").agg(F.count(F.lit(1)).alias("uses"))
    sizes = uses.groupBy("look").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1")
    shared = kept(uses.join(merged(sizes), "look"))
    forms = texts.withColumn("id", own).join(sized_side(shared.select("id")), "id", "left_semi").groupBy("id").agg(F.first("form").alias("form"))
    return shared.join(merged(forms), "id").select("form", "uses", "look", "forms")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    sections = table(spark, folder, "sections").select(F.lit("sections.text").alias("field"), "book_id", "chapter_id", F.col("section_id").alias("record_id"), "text")
    quotes = table(spark, folder, "claims").select(F.lit("claims.quote").alias("field"), "book_id", "chapter_id", F.col("claim_id").alias("record_id"), F.col("span.quote").alias("text"))
    return sections.unionByName(quotes)


def disguises(records: DataFrame) -> DataFrame:
    """records(field, book_id, chapter_id, record_id, text) -> one row per record and kind. Only suspect texts go to Python; only keys are shuffled."""
    bounded_arrow_batches(records.sparkSession)
    keys = ["field", "book_id", "chapter_id", "record_id"]
    suspect = records.where(F.col("text").rlike(SUSPECT))
    return suspect.select(*keys, F.explode(_kinds("text")).alias("disguise")).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with disguised characters."""
    return disguises(_records(spark, folder))


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every quote and section in one form, with whether it changed; repeated rows once."""
    bounded_arrow_batches(spark)
    out = unify_text(_records(spark, folder), "text", "unified")
    return out.select("field", "book_id", "chapter_id", "record_id", "unified", (~F.col("unified").eqNullSafe(F.col("text"))).alias("changed")).distinct()


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes and section texts that look the same but differ, grouped by skeleton."""
    bounded_arrow_batches(spark)
    return same_look_groups(_records(spark, folder), "text")
