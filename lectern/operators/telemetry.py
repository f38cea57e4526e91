"""Roll-ups of run timings and event logs. Rows repeated in full count once; ties in time are broken by the other key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

CHAPTER = ["book_id", "chapter"]


def timings_once(raw: DataFrame) -> DataFrame:
    return raw.distinct()


def latest_runs(timings: DataFrame) -> DataFrame:
    """Per chapter its latest run: seconds without the chapter row and skipped passes, calls, start, end and elapsed seconds."""
    top = timings.groupBy(*CHAPTER).agg(F.max("run").alias("run"))
    rows = timings.alias("t").join(top.alias("r"), (F.col("t.book_id") == F.col("r.book_id")) & F.col("t.chapter").eqNullSafe(F.col("r.chapter")) & (F.col("t.run") == F.col("r.run"))).select("t.*")
    work = (F.col("pass_name") != "chapter") & (F.col("status") != "skipped")
    out = rows.groupBy(*CHAPTER, "run").agg(
        F.count(F.lit(1)).alias("passes"), F.coalesce(F.sum(F.when(work, F.col("seconds").cast("decimal(18,2)"))).cast("double"), F.lit(0.0)).alias("seconds"), F.sum("llm_calls").alias("llm_calls"),
        F.min("started_at").alias("first_start"), F.max("finished_at").alias("last_end"), F.bool_and(F.col("status") == "skipped").alias("all_skipped"), F.bool_or(F.col("status") == "failed").alias("any_failed"),
    )
    return out.withColumn("elapsed_s", F.unix_timestamp("last_end") - F.unix_timestamp("first_start")).withColumn("first_start", F.unix_timestamp("first_start")).withColumn("last_end", F.unix_timestamp("last_end"))


def typical_chapter_seconds(timings: DataFrame, last: int = 12) -> DataFrame:
    """Per book the median of its last done chapter passes of more than a second."""
    done = timings.where("pass_name = 'chapter' and status = 'done' and seconds > 1")
    w = Window.partitionBy("book_id").orderBy(F.col("started_at").desc(), F.col("run").desc())
    return done.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= last).groupBy("book_id").agg(F.bround(F.median("seconds"), 2).alias("typical_s"), F.count(F.lit(1)).alias("chapters"))


def typical_pass_seconds(timings: DataFrame) -> DataFrame:
    """Median, total and number of done passes by name, with the median as text."""
    m = timings.where("status = 'done'").groupBy("pass_name").agg(F.bround(F.median("seconds"), 2).alias("median_s"), F.sum(F.col("seconds").cast("decimal(18,2)")).cast("double").alias("total_s"), F.count(F.lit(1)).alias("passes"), F.sum("llm_calls").alias("llm_calls"))
    return m.withColumn("typical", X.seconds_text(F.col("median_s")))


def running_typical(timings: DataFrame) -> DataFrame:
    """For each done pass the median of the same pass in its book so far, itself excluded."""
    w = Window.partitionBy("book_id", "pass_name").orderBy("started_at", "run", "label").rowsBetween(Window.unboundedPreceding, -1)
    return timings.where("status = 'done'").select("book_id", "run", "pass_name", "label", "seconds", F.bround(F.percentile("seconds", F.lit(0.5)).over(w), 4).alias("typical_s"))


def latest_book_runs(timings: DataFrame) -> DataFrame:
    """Of each book's latest run (run ids share the day and time before the first dash): chapters done, skipped, failed."""
    stamped = timings.where("chapter is not null").withColumn("day", F.substring("run", 1, 8))
    top = stamped.groupBy("book_id").agg(F.max("day").alias("day"))
    chapters = stamped.join(top, ["book_id", "day"]).groupBy("book_id", "day", "chapter").agg(F.bool_and(F.col("status") == "skipped").alias("skipped"), F.bool_or(F.col("status") == "failed").alias("failed"))
    return chapters.groupBy("book_id", "day").agg(F.count(F.lit(1)).alias("chapters"), F.count_if("skipped").alias("n_skipped"), F.count_if("failed").alias("n_failed"), F.count_if(~F.col("skipped") & ~F.col("failed")).alias("n_done"))


def last_failures(timings: DataFrame) -> DataFrame:
    """Per chapter its last failed pass that no later done pass of the same name mended."""
    w = Window.partitionBy(*CHAPTER, "pass_name").orderBy(F.col("started_at").desc(), F.col("run").desc(), F.col("label").desc())
    return timings.where("status in ('failed', 'done')").withColumn("nth", F.row_number().over(w)).where("nth = 1 and status = 'failed'").select(*CHAPTER, "pass_name", "run", "error")


def run_listing(timings: DataFrame, last: int = 3) -> DataFrame:
    """The last runs of each book with their passes in order of start."""
    ranked = timings.withColumn("rank", F.dense_rank().over(Window.partitionBy("book_id").orderBy(F.col("run").desc()))).where(F.col("rank") <= last)
    place = F.row_number().over(Window.partitionBy("book_id", "run").orderBy("started_at", "pass_name", "label", "status", "seconds"))
    return ranked.select("book_id", "run", "rank", place.alias("place"), "pass_name", "status", F.bround("seconds", 2).alias("seconds"))


def status_matrix(timings: DataFrame, passes: list[str]) -> DataFrame:
    """Per chapter the latest status of each pass, as columns."""
    w = Window.partitionBy(*CHAPTER, "pass_name").orderBy(F.col("started_at").desc(), F.col("run").desc(), F.col("label").desc(), F.col("status").desc())
    latest = timings.where("chapter is not null").withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return latest.groupBy(*CHAPTER).agg(*[F.max(F.when(F.col("pass_name") == p, F.col("status"))).alias(f"pass_{p}") for p in passes])


def progress(events: DataFrame) -> DataFrame:
    """Monotone progress of each user's stream: the running maximum of value over event_id, and the seconds since the event before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return events.select("user_id", "event_id", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("progress"), F.floor(gap / 1000000).cast("long").alias("gap_s"))


def latest_status(events: DataFrame) -> DataFrame:
    """Last write wins: each user's last event by offset, with the number of events so far."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("offset"), F.count(F.lit(1)).alias("events"))


def replay(events: DataFrame, after: int, limit: int = 500) -> DataFrame:
    """Events after an offset, in order, as many as a reader takes at once."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(limit)


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Stretches of a user's events without a longer gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    numbered = events.withColumn("session_no", F.sum(F.when(gap.isNull() | (gap > minutes * 60 * 1000000), 1).otherwise(0)).over(w))
    return numbered.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"), F.count_distinct("event_type").alias("kinds"))
