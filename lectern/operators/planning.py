"""Planning over claims: difficulty, top-k choices, coverage, equal blocks, grounding of quotes and merging of passages.

Claims are one row per (book_id, chapter_id, claim_id); repeated rows count once. Ties are broken by claim_no, then claim_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAPTER = ["book_id", "chapter_id"]
# Seconds that a claim of each difficulty takes.
CLAIM_SECONDS = {1: 15, 2: 25, 3: 40, 4: 60, 5: 85}
FORMULA_DENSE, EXPERT_DIFFICULTY = 0.02, 4.0


def claims_once(raw: DataFrame) -> DataFrame:
    """Claims with their span flattened and the ratings clamped to 1..5."""
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(c, F.lit(3))))
    return raw.select(*CHAPTER, "claim_id", "claim_no", "claim", clamp("difficulty").alias("difficulty"), clamp("exam_relevance").alias("relevance"), F.col("span.section").alias("section"), F.col("span.quote").alias("quote"), F.col("span.start").alias("start"), F.col("span.end").alias("end")).dropDuplicates([*CHAPTER, "claim_id"])


def section_difficulty(claims: DataFrame) -> DataFrame:
    """Mean difficulty of each section's claims and whether an expert is needed."""
    return claims.groupBy(*CHAPTER, "section").agg(F.bround(F.avg("difficulty"), 2).alias("difficulty"), F.count(F.lit(1)).alias("claims")).withColumn("expert", F.col("difficulty") > EXPERT_DIFFICULTY)


def hardest_claims(claims: DataFrame) -> DataFrame:
    """Each chapter's hardest claim (difficulty, then relevance, the first on a tie) and its recap claim (the other way round)."""
    first = -F.col("claim_no")
    return claims.groupBy(*CHAPTER).agg(F.max_by("claim_id", F.struct("difficulty", "relevance", first)).alias("hardest"), F.max_by("claim_id", F.struct("relevance", "difficulty", first)).alias("recap"))


def guest_claims(claims: DataFrame, most: int = 4) -> DataFrame:
    """The hardest third of a chapter's claims, at most four, in book order."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*CHAPTER))
    nth = F.row_number().over(Window.partitionBy(*CHAPTER).orderBy(F.col("difficulty").desc(), "claim_no", "claim_id"))
    chosen = claims.withColumn("n", n).withColumn("nth", nth).where(F.col("nth") <= F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / 3))))
    return chosen.select(*CHAPTER, "claim_id", F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("claim_no", "claim_id")).alias("place"))


def landing_claims(claims: DataFrame, most: int = 5) -> DataFrame:
    """Claims of difficulty 4 or more, the hardest and most relevant first, at most five a chapter."""
    w = Window.partitionBy(*CHAPTER).orderBy(F.col("difficulty").desc(), F.col("relevance").desc(), "claim_no", "claim_id")
    return claims.where("difficulty >= 4").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*CHAPTER, "claim_id", "place")


def _block_count(n: Column) -> Column:
    return F.when(n > 0, F.greatest(F.lit(3), F.least(F.lit(5), F.bround(n / 4).cast("int")))).otherwise(3)


def equal_blocks(claims: DataFrame) -> DataFrame:
    """Claims in 3 to 5 blocks of nearly equal size: block i ends at the half-even rounding of i times the mean size."""
    c = claims.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*CHAPTER))).withColumn("i", F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("claim_no", "claim_id")) - 1)
    b = c.withColumn("blocks", _block_count(F.col("n")))
    bounds = F.transform(F.sequence(F.lit(1), F.col("blocks")), lambda k: F.bround(k * F.col("n") / F.col("blocks")).cast("int"))
    return b.select(*CHAPTER, "claim_id", (F.size(F.filter(bounds, lambda x: x <= F.col("i"))) + 1).alias("block_no"))


def quiz_claims(claims: DataFrame, questions: int = 3) -> DataFrame:
    """Relevant claims (4 or more, if a chapter has any): the best of each block first, the rest after, as many as questions, in book order."""
    blocks = claims.join(equal_blocks(claims), [*CHAPTER, "claim_id"])
    any_ = F.max("relevance").over(Window.partitionBy(*CHAPTER)) >= 4
    pool = blocks.withColumn("any", any_).where("relevance >= 4 or not any")
    best = F.row_number().over(Window.partitionBy(*CHAPTER, "block_no").orderBy(F.col("relevance").desc(), F.col("difficulty").desc(), "claim_no", "claim_id"))
    ranked = pool.withColumn("in_block", best).withColumn("nth", F.row_number().over(Window.partitionBy(*CHAPTER).orderBy(F.when(F.col("in_block") == 1, 0).otherwise(1), F.col("relevance").desc(), F.col("difficulty").desc(), "claim_no", "claim_id")))
    return ranked.where(F.col("nth") <= questions).select(*CHAPTER, "claim_id", F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("claim_no", "claim_id")).alias("place"))


def chapter_need(claims: DataFrame) -> DataFrame:
    """Seconds that a chapter's claims take, its blocks and the characters that fill that time."""
    per = F.element_at(F.create_map(*[F.lit(x) for kv in CLAIM_SECONDS.items() for x in kv]), F.col("difficulty"))
    a = claims.groupBy(*CHAPTER).agg(F.sum(per).alias("seconds"), F.count(F.lit(1)).alias("claims"))
    return a.select(*CHAPTER, "seconds", "claims", _block_count(F.col("claims")).alias("blocks"), F.floor(F.col("seconds") * 15 * 0.9).cast("long").alias("chars"))


def bare_sections(sections: DataFrame, claims: DataFrame, least: int = 400) -> DataFrame:
    """Sections of at least that many characters that no claim refers to."""
    s = sections.where(F.length("text") >= least).select(*CHAPTER, "section_id", F.length("text").alias("chars")).dropDuplicates([*CHAPTER, "section_id"])
    return s.join(claims.select(*CHAPTER, F.col("section").alias("section_id")).distinct(), [*CHAPTER, "section_id"], "left_anti")


def located_quotes(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Exact place of each quote: as written (score 100), else without regard to case (99), in the stated section first, then in the
    chapter's other sections in order; quotes found nowhere get their stated section with score 0. Positions start at 0.

    The stated section is one equi-join; only quotes not found there meet the chapter's other sections.
    """
    texts = sections.where("text is not null").select(*CHAPTER, "section_id", "section_no", "text").dropDuplicates([*CHAPTER, "section_id"])
    asked = claims.where("quote is not null and quote <> ''").select(*CHAPTER, "claim_id", "section", "quote")

    def hit(df: DataFrame) -> DataFrame:
        exact, folded = F.expr("locate(quote, text)"), F.expr("locate(lower(quote), lower(text))")
        score = F.when(exact > 0, 100).when(folded > 0, 99).otherwise(0)
        return df.withColumn("at", F.when(exact > 0, exact).otherwise(folded)).withColumn("score", score)

    stated = hit(asked.join(texts.withColumnRenamed("section_id", "section"), [*CHAPTER, "section"], "left"))
    found = stated.where("score > 0").select(*CHAPTER, "claim_id", F.col("section").alias("section_id"), (F.col("at") - 1).alias("start_pos"), (F.col("at") - 1 + F.length("quote")).alias("end_pos"), "score")
    rest = stated.where("score = 0 or score is null").select(*CHAPTER, "claim_id", "section", "quote")
    others = hit(rest.join(texts, CHAPTER)).where("score > 0")
    first = Window.partitionBy(*CHAPTER, "claim_id").orderBy("section_no", "section_id")
    elsewhere = others.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*CHAPTER, "claim_id", "section_id", (F.col("at") - 1).alias("start_pos"), (F.col("at") - 1 + F.length("quote")).alias("end_pos"), "score")
    lost = rest.join(elsewhere, [*CHAPTER, "claim_id"], "left_anti").select(*CHAPTER, "claim_id", F.col("section").alias("section_id"), F.lit(0).alias("start_pos"), F.lit(0).alias("end_pos"), F.lit(0).alias("score"))
    return found.unionByName(elsewhere).unionByName(lost)


def merged_passages(located: DataFrame, context: int = 200) -> DataFrame:
    """Passages around located quotes, widened by context; overlapping or touching ones of a section are one, with their number of claims."""
    wide = located.where("score > 0").select(*CHAPTER, "section_id", "claim_id", F.greatest(F.lit(0), F.col("start_pos") - context).alias("lo"), (F.col("end_pos") + context).alias("hi"))
    w = Window.partitionBy(*CHAPTER, "section_id").orderBy("lo", "hi", "claim_id")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = wide.withColumn("new", (reach.isNull() | (F.col("lo") > reach)).cast("int")).withColumn("passage_no", F.sum("new").over(w))
    return islands.groupBy(*CHAPTER, "section_id", "passage_no").agg(F.min("lo").alias("start_pos"), F.max("hi").alias("end_pos"), F.count(F.lit(1)).alias("claims"))


def coverage_sets(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Per episode: planned, told, told and planned, planned but untold claims, by set algebra on arrays of distinct ids."""
    told = lines.groupBy("book_id", F.col("episode_id").alias("chapter_id"), "revision").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("told"))
    planned = claims.groupBy(*CHAPTER).agg(F.collect_set("claim_id").alias("planned"))
    j = told.join(planned, CHAPTER)
    return j.select(*CHAPTER, "revision", F.size("planned").alias("planned"), F.size("told").alias("told"), F.size(F.array_intersect("told", "planned")).alias("both"), F.size(F.array_except("planned", "told")).alias("untold"))


def revision_overlap(lines: DataFrame) -> DataFrame:
    """Lines of an episode's first revision that its last revision still has, word for word, and those it lost."""
    keyed = lines.select("book_id", "episode_id", "revision", "text").where("text is not null").distinct()
    ends = keyed.groupBy("book_id", "episode_id").agg(F.min("revision").alias("lo"), F.max("revision").alias("hi")).where("lo < hi")
    old = keyed.join(ends, ["book_id", "episode_id"]).where("revision = lo").select("book_id", "episode_id", "text")
    new = keyed.join(ends, ["book_id", "episode_id"]).where("revision = hi").select("book_id", "episode_id", "text")
    kept = old.join(new, ["book_id", "episode_id", "text"], "left_semi").groupBy("book_id", "episode_id").agg(F.count(F.lit(1)).alias("kept"))
    lost = old.join(new, ["book_id", "episode_id", "text"], "left_anti").groupBy("book_id", "episode_id").agg(F.count(F.lit(1)).alias("lost"))
    return ends.select("book_id", "episode_id").join(kept, ["book_id", "episode_id"], "left").join(lost, ["book_id", "episode_id"], "left").na.fill(0)
