"""Problem 8: mixing sources to target weights.

Method: capped water-filling. A mix takes total x weight tokens from each source; a source that can't give that much within its
largest number of repeats is clamped there and its excess is shared among the others in proportion to their weights, until all
fit. The amount of a source is then whole repeats of all its documents and a seeded sample for the fraction.

The seeded sample orders a source's documents by a hash and takes them until the fraction is reached. Documents fall into hash
buckets first, so the place where the fraction ends is found on bucket sums and only one bucket is looked at row by row; a source
that holds a third of all rows stays spread.

Null texts and null sources aren't mixed; empty texts have no tokens and come along with whole repeats; a doc_id counts once (of rows that
differ, the one with the last source and most tokens);
sources without documents leave their weight to the others; documents of sources outside the mix are not used; extra columns
are not read. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import bounded_arrow_batches, ensure_checkpoint_dir
from lectern.sources.tables import table

BUCKETS = 4096
#: Fixed value: the word pattern that the byte-level vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary; LECTERN_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def with_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): lengths of the texts in tokens; the vocabulary is read by each worker once."""
    path = vocabulary or default_vocabulary()
    bounded_arrow_batches(documents.sparkSession)

    @F.pandas_udf(T.IntegerType())
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for part in parts:
            yield part.map(lambda t: len(encode(t)))

    sized = documents.where("text is not null and source is not null").select("doc_id", "source", tokens("text").alias("tokens"))
    return sized.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")


def water_fill(sources: list[tuple[str, float, int, int]], total: float | None = None) -> dict[str, float]:
    """sources (name, weight, largest repeats, tokens) -> tokens to take. Without a total: all tokens that there are once.

    The result adds up to the total, or to all that the caps allow.
    """
    caps = {n: float(max(0, r) * t) for n, w, r, t in sources}
    weights = {n: max(0.0, w) for n, w, r, t in sources if caps[n] > 0 and w and w > 0}
    rest = float(sum(t for n, _, _, t in sources if n in weights)) if total is None else float(total)
    take = {n: 0.0 for n, *_ in sources}
    open_ = dict(weights)
    while open_ and rest > 0:
        share = sum(open_.values())
        full = [n for n, w in open_.items() if w / share * rest >= caps[n]]
        if not full:
            for n, w in open_.items():
                take[n] = w / share * rest
            break
        for n in full:
            take[n] = caps[n]
        rest -= sum(caps[n] for n in full)
        open_ = {n: w for n, w in open_.items() if n not in full}
    return take


def balanced_total(sources: list[tuple[str, float, int, int]]) -> float:
    """The largest total at which every source with documents still reaches its share of the weights."""
    given = [(w, r * t) for _, w, r, t in sources if w and w > 0 and r > 0 and t > 0]
    share = sum(w for w, _ in given)
    return min((cap * share / w for w, cap in given), default=0.0)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, total: str = "balanced", vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares): per mix and document its number of repeats; per mix and source the wanted and the reached share.

    total: 'balanced' (every share is reached, up to one document a source) or 'all' (as many tokens as there are once, shares as
    near as the caps allow). Source sums and targets are one row per source and mix and are brought to the driver.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    sized = with_tokens(documents, vocabulary).withColumn("turn", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.shiftrightunsigned("turn", 52).cast("int")).checkpoint()
    wanted = targets.groupBy("mix_name", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    rows = wanted.join(have, "source", "left").na.fill(0).collect()  # one row per mix and source
    plans = []
    for name in sorted({r["mix_name"] for r in rows}):
        own = [(r["source"], r["weight"], r["max_repeats"], r["tokens"]) for r in rows if r["mix_name"] == name]
        take = water_fill(own, balanced_total(own) if total == "balanced" else None)
        for source, weight, _, tokens in own:
            whole = int(take[source] // tokens) if tokens else 0
            plans.append((name, source, float(weight), float(take[source]), whole, take[source] - whole * tokens if tokens else 0.0))
    plan = F.broadcast(spark.createDataFrame(plans, "mix_name string, source string, weight double, wanted double, whole int, part double"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))  # at most BUCKETS rows a source
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumn("earlier", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    cut = plan.where("part > 0").join(edges, "source").where("earlier < part and part <= earlier + in_bucket").select("mix_name", "source", F.col("bucket").alias("cut_bucket"), "earlier")
    inside = sized.join(F.broadcast(cut), (sized.source == cut.source) & (sized.bucket == cut.cut_bucket)).select("mix_name", sized.source, "doc_id", "tokens", "turn", "earlier")
    upto = Window.partitionBy("mix_name", "source").orderBy("turn", "doc_id")
    ended = inside.withColumn("at", F.col("earlier") + F.sum("tokens").over(upto) - F.col("tokens")).select("mix_name", "source", "doc_id", "at")
    used = sized.join(plan, "source").join(F.broadcast(cut.select("mix_name", "source", "cut_bucket")), ["mix_name", "source"], "left").join(ended, ["mix_name", "source", "doc_id"], "left")
    half = (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & (F.col("at") + F.col("tokens") / 2 <= F.col("part")))
    uses = used.withColumn("repeats", F.col("whole") + F.coalesce(half, F.lit(False)).cast("int")).where("repeats > 0").select("mix_name", "source", "doc_id", "tokens", "repeats")
    reached = uses.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_repeats"))
    joined = plan.join(reached, ["mix_name", "source"], "left").na.fill(0, ["tokens", "uses", "most_repeats"])
    all_ = Window.partitionBy("mix_name")
    shares = joined.select("mix_name", "source", "weight", F.round("wanted", 1).alias("wanted_tokens"), "tokens", "uses", "most_repeats", F.round(F.col("tokens") / F.sum("tokens").over(all_), 6).alias("reached_share"))
    return uses, shares


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each mix with their repeats."""
    return mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares wanted and reached."""
    return mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))[1]


def p8_shares_all(spark: SparkSession, folder: str) -> DataFrame:
    """Shares when as many tokens are wanted as there are once."""
    return mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"), total="all")[1]


def p8_mix_all(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each mix with their repeats when as many tokens are wanted as there are once."""
    return mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"), total="all")[0]
