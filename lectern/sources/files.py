"""Readers and writers of files other than the parquet tables."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMINGS = "run string, book_id string, chapter string, pass_name string, label string, status string, started_at timestamp, finished_at timestamp, seconds double, llm_calls int, error string"
CONTINUITY = "episode string, ln int, callbacks array<string>, running_jokes array<string>, mistakes array<string>, open_threads array<string>, guest string, recorded_at timestamp"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; a line that a crash cut off is left out, unknown fields are ignored, missing ones null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, one a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_by_key(df: DataFrame, path: str, key: str = "content_key") -> None:
    """Content-addressed store: files partitioned by the first two characters of the key; rows whose key is stored already are left out."""
    spark = df.sparkSession
    new = df.withColumn("prefix", F.substring(key, 1, 2)).dropDuplicates([key])
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stored = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    old = spark.read.parquet(path).select(key) if stored else None
    (new.join(old, key, "left_anti") if old is not None else new).write.mode("append").partitionBy("prefix").parquet(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A book in Markdown as units (path, unit_no, kind, text): title, chapter, section and source lines, other lines joined to paragraphs."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    kind = F.when(F.trim("line") == "", "blank").when(F.col("line").startswith("### "), "section").when(F.col("line").startswith("## "), "chapter").when(F.col("line").startswith("# "), "title").when(F.col("line").startswith("- "), "source").otherwise("para")
    w = Window.partitionBy("path").orderBy("line_no")
    k = lines.withColumn("kind", kind)
    new = (F.col("kind") != "para") | ~F.lag("kind").over(w).eqNullSafe("para")
    units = k.withColumn("unit", F.sum(new.cast("int")).over(w)).where("kind <> 'blank'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim(F.regexp_replace("line", "^(#+|-) ", "")).alias("t")))), lambda x: x["t"]), " ")
    grouped = units.groupBy("path", "unit", "kind").agg(text.alias("text"))
    return grouped.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("unit")) - 1).alias("unit_no"), "kind", "text")


_CLIP = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])


@F.pandas_udf(_CLIP)
def _decoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for content in part:
            with wave.open(io.BytesIO(content)) as clip:
                kind = {1: np.uint8, 2: np.int16, 4: np.int32}[clip.getsampwidth()]
                raw = np.frombuffer(clip.readframes(clip.getnframes()), kind).astype(np.float32)
                raw = (raw - 128) / 128 if kind is np.uint8 else raw / np.iinfo(kind).max
                rows.append((clip.getframerate(), raw.reshape(-1, clip.getnchannels()).mean(axis=1).tolist()))
        yield pd.DataFrame(rows, columns=["rate", "samples"])


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """PCM audio files as (path, rate, samples), channels averaged."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", _decoded("content").alias("c")).select("path", "c.rate", "c.samples")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with size and time, without those in a part named cache."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.col("path").rlike("/cache/")).select("path", F.col("length").alias("bytes"), "modificationTime")


def last_written(log: DataFrame, key: str = "episode", order: str = "ln", last: int = 10) -> DataFrame:
    """Last write wins per key, in order of the last write, the newest ``last`` (a top-k report)."""
    newest = log.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("nth = 1").drop("nth")
    return newest.orderBy(F.col(order).desc()).limit(last).orderBy(order)
