"""Queries over ordered folds and model calls. SQL can't express the folds; tests compare them with plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import external as E
from lectern.operators import folds as W
from lectern.operators import script as S
from lectern.operators import structure as D
from lectern.sources.tables import table


def _lines(spark, folder):
    return S.script_lines(table(spark, folder, "script_lines"))


def _summaries(spark, folder):
    requests = D.texts_once(table(spark, folder, "sections")).select(F.lit("summary").alias("task"), F.col("text").alias("prompt"))
    answers = E.parsed(E.called(requests), "summary")
    return answers.select("request_hash", "tries", F.col("value.summary").alias("summary"), F.size("value.claims").alias("claims"))


QUERIES = {
    "script_emotion_carry": lambda spark, folder: W.emotion_carry(_lines(spark, folder), table(spark, folder, "speakers")),
    "script_blocks": lambda spark, folder: W.script_blocks(_lines(spark, folder)),
    "script_timeline": lambda spark, folder: W.timeline(W.script_turns(_lines(spark, folder))),
    "script_unwritten_gaps": lambda spark, folder: W.unwritten_gaps(W.timeline(W.script_turns(_lines(spark, folder)))),
    "sections_kept_paragraphs": lambda spark, folder: W.kept_paragraphs(D.paragraphs(table(spark, folder, "sections"))),
    "sections_model_summaries": _summaries,
}
SQL: dict[str, str] = {}
