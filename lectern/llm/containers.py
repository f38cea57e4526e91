"""Problem 3: filling containers of fixed capacity, no item being split unless it alone exceeds the capacity.

Method: bulk-synchronous best fit. Items are range-sorted by size and ranked; gaps are kept sorted by room. In each round every
waiting item seeks its successor, the smallest gap with room for it, by one sweep over both sorted sides; where several items
want the same gaps, rank decides, each gap taking at most one item; gaps shrink; rounds go on until no gap takes an item, then
new containers are opened for the largest waiting items and the rounds go on.

Items of one size are interchangeable, and so are gaps of one room. A sweep therefore runs over size classes: whole numbers from
1 to the capacity, so the state is bounded by the capacity whatever the number of items. Only class counts (at most capacity
rows) reach the driver, and only the plan (rank intervals of each class) goes back; items find their interval by rank.

An item over the capacity fills whole containers and leaves a rest that is packed like an item. Null sizes count as 0; items of
size 0 need no room and share container 0; repeated rows count once; ties in size are ranked by key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import ensure_checkpoint_dir
from lectern.sources.tables import table

SECTION_CAPACITY, BLOCK_CAPACITY = 8000, 3000


def plan(counts: dict[int, int], capacity: int, first: int = 0) -> list[tuple[int, int, int, int]]:
    """(size, first rank, number, first container): which rank interval of a size class goes to which containers."""
    waiting = {s: (0, n) for s, n in counts.items() if n > 0 and s > 0}  # size -> next rank, number left
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> intervals of containers (first, number)
    out: list[tuple[int, int, int, int]] = []
    opened = first

    def put(size: int, intervals: list[tuple[int, int]], room: int, n: int, later: dict[int, list[tuple[int, int]]]) -> None:
        """n items of the class into containers taken from the front of the intervals; what is left of their room waits in later."""
        rank, left = waiting[size]
        while n:
            start, number = intervals[0]
            k = min(n, number)
            out.append((size, rank, k, start))
            if room > size:
                later[room - size].append((start, k))
            intervals[:1] = [(start + k, number - k)] if number > k else []
            rank, left, n = rank + k, left - k, n - k
        waiting[size] = (rank, left)

    while True:
        moved = True
        while moved:
            moved, later = False, defaultdict(list)
            rooms = sorted(r for r, x in gaps.items() if x)
            for size in sorted(waiting, reverse=True):
                i = int(np.searchsorted(rooms, size))
                while waiting[size][1] and i < len(rooms):
                    room = rooms[i]
                    free = sum(n for _, n in gaps[room])
                    if free:
                        put(size, gaps[room], room, min(free, waiting[size][1]), later)
                        moved = True
                    if not gaps[room]:
                        rooms.pop(i)
                    else:
                        i += 1
            for room, intervals in later.items():
                gaps[room].extend(intervals)
        left = {s: n for s, (_, n) in waiting.items() if n}
        if not left:
            return out
        waiting = {s: x for s, x in waiting.items() if x[1]}
        total = sum(s * n for s, n in left.items())
        large = sum(n for s, n in left.items() if 2 * s > capacity)
        new = max(1, large, total // capacity)
        for size in sorted(left, reverse=True):
            k = min(new, left[size])
            if k:
                put(size, [(opened, k)], capacity, k, gaps)
                opened, new = opened + k, new - k


def _ranked(items: DataFrame, keys: list[str]) -> DataFrame:
    """items with their rank within their size: range-sorted, kept in the checkpoint folder (a range's bounds are sampled, so
    they must not be drawn twice), then numbered inside each range and offset by the counts of earlier ranges. No class, however
    many items have its size, is ever in one task."""
    ensure_checkpoint_dir(items.sparkSession)
    spread = items.repartitionByRange(F.col("size").desc(), *map(F.col, keys)).sortWithinPartitions(F.col("size").desc(), *keys)
    numbered = spread.withColumn("at", F.monotonically_increasing_id()).checkpoint()
    numbered = numbered.withColumn("range", F.shiftright("at", 33))
    heads = numbered.groupBy("size", "range").agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0))).select("size", "range", "head", "offset")
    return numbered.join(heads, ["size", "range"]).withColumn("rank", F.col("at") - F.col("head") + F.col("offset")).drop("at", "range", "head", "offset")


def pack(items: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """items(keys, size) -> (keys, piece_no, pieces, chars, container): each item's containers; pieces > 1 where it was split.

    Rows with the same keys count once, with the largest size.
    """
    spark = items.sparkSession
    once = items.groupBy(*keys).agg(F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("chars"))
    shaped = once.withColumn("full", F.greatest(F.floor((F.col("chars") - 1) / capacity), F.lit(0))).withColumn("size", (F.col("chars") - F.col("full") * capacity).cast("int"))
    ranked = _ranked(shaped, keys)
    histogram = {r["size"]: r["n"] for r in ranked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    rows = plan(histogram, capacity, 1)
    steps = pd.DataFrame(rows or [(0, 0, 0, 0)], columns=["size", "rank", "n", "container"]).sort_values(["size", "rank"])
    keyed = (steps["size"].to_numpy(np.int64) << 40) + steps["rank"].to_numpy(np.int64)
    starts = steps["container"].to_numpy(np.int64) - steps["rank"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((keyed, starts))  # bounded by rounds x capacity, not by the items

    @F.pandas_udf(T.LongType())
    def container(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        edges, offset = shared.value
        for size, rank in parts:
            key = (size.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
            at = np.searchsorted(edges, key, side="right") - 1
            yield pd.Series(np.where(size.to_numpy() > 0, rank.to_numpy(np.int64) + offset[at], 0))

    placed = ranked.withColumn("container", container("size", "rank"))
    last = placed.select(*keys, F.col("full").cast("int").alias("piece_no"), (F.col("full") + 1).cast("int").alias("pieces"), F.col("size").alias("chars"), F.concat(F.lit("c"), F.col("container")).alias("container"))
    name = F.concat_ws("/", F.lit("own"), *[F.col(k).cast("string") for k in keys])
    whole = placed.where("full > 0").select(*keys, F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece_no"), (F.col("full") + 1).cast("int").alias("pieces"), F.lit(capacity).alias("chars"), name.alias("own"))
    whole = whole.select(*keys, "piece_no", "pieces", "chars", F.concat_ws("/", "own", "piece_no").alias("container"))
    return last.unionByName(whole)


def block_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, episode_id, block_id, size): blocks of the latest revision with the characters of their lines, each line once."""
    unit = ["book_id", "episode_id", "revision"]
    lines = table(spark, folder, "script_lines").select(*unit, "line_id", F.length("text").alias("n"))
    blocks = table(spark, folder, "blocks").select(*unit, "block_id", "line_ids")
    latest = lines.select(*unit).unionByName(blocks.select(*unit)).groupBy("book_id", "episode_id").agg(F.max("revision").alias("revision"))
    current = blocks.join(latest, unit)
    asked = current.select(*unit, "block_id", F.explode(F.array_distinct("line_ids")).alias("line_id")).distinct()
    sizes = lines.groupBy(*unit, "line_id").agg(F.max("n").alias("n"))
    summed = asked.join(sizes, [*unit, "line_id"], "left").groupBy("book_id", "episode_id", "block_id").agg(F.sum("n").alias("size"))
    empty = current.where("line_ids is null or size(line_ids) = 0").select("book_id", "episode_id", "block_id", F.lit(0).cast("long").alias("size"))
    return summed.unionByName(empty)


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks in containers of 3000 characters."""
    return pack(block_sizes(spark, folder), ["book_id", "episode_id", "block_id"], BLOCK_CAPACITY)


def p3_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections in containers of 8000 characters; only keys and lengths are shuffled."""
    sizes = table(spark, folder, "sections").select("book_id", "section_id", F.length("text").alias("size"))
    return pack(sizes, ["book_id", "section_id"], SECTION_CAPACITY)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks that packing had to split: those that lie in more than one container."""
    placed = p3_blocks(spark, folder).groupBy("book_id", "episode_id", "block_id").agg(F.min("container").alias("one"), F.max("container").alias("other"))
    return placed.where("one <> other").select("book_id", "episode_id", "block_id")


P3_FOUND_SQL = """
with l as (select book_id, episode_id, revision, line_id, max(length(text)) as n from script_lines group by all),
latest as (select book_id, episode_id, max(revision) as revision from (select book_id, episode_id, revision from script_lines union all select book_id, episode_id, revision from blocks) group by all),
b as (select distinct book_id, episode_id, revision, block_id, unnest(line_ids) as line_id from blocks join latest using (book_id, episode_id, revision))
select book_id, episode_id, block_id from b join l using (book_id, episode_id, revision, line_id)
group by book_id, episode_id, block_id having sum(n) > 3000
"""
