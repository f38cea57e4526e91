"""Inexact text matching: partial and token-set ratios, and quotes located by their best passage.

Scores are 0 to 100. The best window of equal scores is the one that starts first. Null texts have a null score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.matching import indel_ratio
from lectern.operators.planning import CHAPTER

LEAST_SCORE = 80.0


def best_window(needle: str, text: str, least: float = 0.0) -> tuple[int, int, float] | None:
    """(start, end, score) of the window of the text that is most like the needle, or None below the least score.

    Windows have the needle's length, shorter ones only at the text's ends. How many characters a window shares with the needle
    bounds its score from above, is kept up to date from window to window, and spares most comparisons.
    """
    n, m = len(needle), len(text)
    if not n or not m:
        return None
    if n >= m:
        score = indel_ratio(needle, text)
        return (0, m, score) if score >= least else None
    want, have, shared = Counter(needle), Counter(), 0
    best: tuple[int, int, float] | None = None
    for right in range(1, m + n):
        left = right - n
        if right <= m:
            c = text[right - 1]
            have[c] += 1
            shared += have[c] <= want[c]
        if left > 0:
            c = text[left - 1]
            shared -= have[c] <= want[c]
            have[c] -= 1
        lo, hi = max(0, left), min(m, right)
        bound = 200.0 * shared / (n + hi - lo)
        if bound < least or best and bound <= best[2]:
            continue
        score = indel_ratio(needle, text[lo:hi])
        if score >= least and (best is None or score > best[2]):
            best = (lo, hi, score)
            if score == 100.0:
                break
    return best


def partial_ratio(a: str, b: str) -> float:
    """The shorter text against its best window of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    hit = best_window(short, long)
    return hit[2] if hit else 0.0


def token_set_ratio(a: str, b: str) -> float:
    """Texts as sets of words: the common words against each side's words, whichever agrees best."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    left, right = " ".join(filter(None, [both, *only_x])), " ".join(filter(None, [both, *only_y]))
    scores = [indel_ratio(left, right)]
    if both:
        scores += [indel_ratio(both, left), indel_ratio(both, right)]
    return max(scores)


_HIT = T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("score", T.DoubleType())])


@F.pandas_udf(_HIT)
def _hit(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for quotes, texts in parts:
        rows = [best_window(q, t, LEAST_SCORE) if isinstance(q, str) and isinstance(t, str) else None for q, t in zip(quotes, texts)]
        yield pd.DataFrame([r or (None, None, None) for r in rows], columns=["start_pos", "end_pos", "score"]).astype({"start_pos": "Int32", "end_pos": "Int32", "score": "float64"})


def fuzzy_quotes(located: DataFrame, claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Quotes that exact search found nowhere, at their best passage of at least LEAST_SCORE: in the stated section, else in the chapter."""
    lost = located.where("score = 0").select(*CHAPTER, "claim_id").join(claims.select(*CHAPTER, "claim_id", "section", "quote"), [*CHAPTER, "claim_id"])
    texts = sections.where("text is not null").select(*CHAPTER, "section_id", "section_no", "text").dropDuplicates([*CHAPTER, "section_id"])
    tried = lost.join(texts, CHAPTER).select(*CHAPTER, "claim_id", "section", "section_id", "section_no", _hit("quote", "text").alias("h")).where("h.score is not null")
    order = Window.partitionBy(*CHAPTER, "claim_id").orderBy((F.col("section_id") != F.col("section")), F.col("h.score").desc(), "section_no", "section_id")
    best = tried.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return best.select(*CHAPTER, "claim_id", "section_id", "h.start_pos", "h.end_pos", F.bround("h.score", 2).alias("score"))


def window_words(text: str, start: int, end: int) -> tuple[int, int]:
    """A window widened to whole words."""
    while start > 0 and text[start - 1].isalnum() and start < len(text) and text[start].isalnum():
        start -= 1
    while end < len(text) and text[end].isalnum() and end > 0 and text[end - 1].isalnum():
        end += 1
    return start, end
