"""Session helper: the settings every lectern job expects, each overridable by the caller."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults for local runs; a cluster's own settings win because they are set before the session exists.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "lectern") -> SparkSession:
    """A local session for tests and bench runs."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "12g")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoint(): the cluster's ``spark.checkpoint.dir``, else (local runs only) a fresh temporary one.

    On a cluster without that setting this raises, because a machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def bounded_arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches of long texts small, so that a Python worker holds a few MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows up to which a table of short rows (keys and a few words) is broadcast; some tens of MB at most.
BROADCAST_ROWS = 100_000


def kept(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that several readers share one computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, placed: bool = False) -> DataFrame:
    """kept(), and the shuffle files that were written for it go at once instead of when the driver happens to collect its garbage.

    placed: the partitioning of df is known to its readers, so that what is done within it isn't shuffled again; an adaptive plan
    doesn't tell its own, so df is run as it is first planned.
    """
    spark = df.sparkSession
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.adaptive.enabled": "false"} if placed else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return kept(df.select("*"))  # a query follows the settings of the moment when it is made
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sized_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df as a join's side: broadcast if it was counted and has at most ``most`` rows, else merge-joined, which has no size limit.

    df should be kept() or cheap, as it is counted here.
    """
    return F.broadcast(df) if len(df.select(F.lit(1)).take(most + 1)) <= most else df.hint("merge")


def merged(df: DataFrame) -> DataFrame:
    """df as the side of a merge join: for tables that grow with the data, whatever size the optimizer guesses."""
    return df.hint("merge")
