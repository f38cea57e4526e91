"""Rules on lines that are copied: from the book, from the plan, or from voice samples. Null texts copy nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X
from lectern.operators import planning as P
from lectern.operators.fuzzy import best_window
from lectern.operators.matching import indel_ratio, ratio
from lectern.operators.script import EPISODE, found

# Scores from which a line counts as copied, and the least lengths.
SOURCE_SCORE, SOURCE_CHARS, SAMPLE_SCORE, SAMPLE_CHARS = 88.0, 40, 85.0, 20


def copies_source(quote: str, claim: str, line: str) -> bool:
    """Whether a line is the quote (a part of the line if it is shorter) or the claim itself; all texts flattened."""
    if len(line) >= SOURCE_CHARS and len(quote) >= SOURCE_CHARS:
        if len(quote) > len(line) and indel_ratio(quote, line) >= SOURCE_SCORE or len(quote) <= len(line) and best_window(quote, line, SOURCE_SCORE):
            return True
    return len(claim) >= SOURCE_CHARS and indel_ratio(claim, line) >= SOURCE_SCORE


@F.pandas_udf(T.BooleanType())
def _copies(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for quotes, claims, lines in parts:
        yield pd.Series([copies_source(q or "", c or "", t or "") for q, c, t in zip(quotes, claims, lines)], dtype=bool)


def source_copy(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """source_copy: a line that is the sentence of the book or of the plan for a claim it covers; the first such claim of a line."""
    told = lines.where("text is not null").select(*EPISODE, "line_id", X.flat(F.col("text")).alias("flat"), F.posexplode("covers").alias("place", "claim_id"))
    plan = claims.select("book_id", F.col("chapter_id").alias("episode_id"), "claim_id", X.flat(F.coalesce("quote", F.lit(""))).alias("quote_flat"), X.flat(F.coalesce("claim", F.lit(""))).alias("claim_flat"))
    both = told.join(plan, ["book_id", "episode_id", "claim_id"]).where((F.length("quote_flat") >= SOURCE_CHARS) | (F.length("claim_flat") >= SOURCE_CHARS))
    copied = both.where(_copies("quote_flat", "claim_flat", "flat"))
    first = F.row_number().over(Window.partitionBy(*EPISODE, "line_id").orderBy("place"))
    return found(copied.withColumn("nth", first).where("nth = 1"), "source_copy", "warning", claim="claim_id")


def sample_copy(lines: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_copy: a line nearly the same as one of samples(text).

    Two texts that reach the score differ in length by a factor under 1.36, so both sides are joined on a length class of that
    width and its neighbours; Levenshtein, which the ratio bounds, spares most comparisons.
    """
    width = 1.36
    size = lambda c: F.floor(F.log(F.length(c)) / F.log(F.lit(width))).cast("int")
    folded = lines.select(*EPISODE, "line_id", F.lower(X.squash(F.col("text"))).alias("said")).where(F.length("said") >= SAMPLE_CHARS).withColumn("size", size("said"))
    given = samples.where(F.length("text") >= SAMPLE_CHARS).select(F.lower(X.squash(F.col("text"))).alias("sample")).distinct()
    classes = given.select("sample", F.explode(F.array(size("sample") - 1, size("sample"), size("sample") + 1)).alias("size"))
    most = ((1 - SAMPLE_SCORE / 100) * (F.length("said") + F.length("sample"))).cast("int")
    near = folded.join(classes, "size").where(F.levenshtein("said", "sample") <= most)
    return found(near.where(ratio("said", "sample") >= SAMPLE_SCORE).select(*EPISODE, "line_id").distinct(), "sample_copy")
