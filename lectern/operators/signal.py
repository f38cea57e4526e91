"""Array operators on samples held as ARRAY<FLOAT>; all are higher-order functions, no Python. An empty array has level null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples)))


def to_db(gain: Column) -> Column:
    return 20 * F.log10(gain + F.lit(1e-9))


def to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def faded(samples: Column, n: int) -> Column:
    """Linear fade over the first and last n samples."""
    size = F.size(samples)
    return F.transform(samples, lambda x, i: x.cast("double") * F.least(F.lit(1.0), (i + 1) / F.lit(n), (size - i) / F.lit(n)))


def normalised(samples: Column, target_db: float, most: float = 30.0) -> Column:
    """Samples at the target level; the gain is clamped to +-most dB."""
    gain = to_gain(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(target_db) - to_db(rms(samples)))))
    return F.transform(samples, lambda x: x.cast("double") * gain)


def clip_levels(clips: DataFrame) -> DataFrame:
    """Level, peak and the gain to -20 dB of each clip."""
    s = F.col("embedding")
    return clips.select("vec_id", F.round(to_db(rms(s)), 4).alias("rms_db"), F.round(F.array_max(F.transform(s, lambda x: F.abs(x.cast("double")))), 6).alias("peak"), F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -20 - to_db(rms(s)))), 4).alias("gain_db"))


def frame_levels(clips: DataFrame, hop: int = 8) -> DataFrame:
    """Level of every frame of hop samples, and whether it is below the clip's mean level by 6 dB."""
    frames = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / hop).cast("int")), lambda k: F.slice("embedding", k * hop + 1, hop))
    each = clips.where("size(embedding) > 0").select("vec_id", to_db(rms(F.col("embedding"))).alias("mean_db"), F.posexplode(frames).alias("frame", "x"))
    return each.select("vec_id", "frame", F.round(to_db(rms(F.col("x"))), 4).alias("db"), (to_db(rms(F.col("x"))) < F.col("mean_db") - 6).alias("quiet"))


def pauses(frames: DataFrame) -> DataFrame:
    """Runs of quiet frames: clip, first frame, length."""


    w = Window.partitionBy("vec_id").orderBy("frame")
    island = frames.where("quiet").withColumn("island", F.col("frame") - F.row_number().over(w))
    return island.groupBy("vec_id", "island").agg(F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("frames")).drop("island")


def labelled_levels(clips: DataFrame) -> DataFrame:
    """Per label the mean level of each quarter of the clip and its difference from the mean of all labels, in dB."""


    quarter = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", (k * F.size("embedding") / 4).cast("int") + 1, (F.size("embedding") / 4).cast("int")))
    each = clips.where("size(embedding) >= 4").select("label", F.posexplode(quarter).alias("band", "x")).groupBy("label", "band").agg(F.avg(to_db(rms(F.col("x")))).alias("db"))
    mean = F.avg("db").over(Window.partitionBy("band"))
    return each.select("label", "band", F.round("db", 3).alias("db"), F.round(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), mean - F.col("db"))), 3).alias("correction_db"))
