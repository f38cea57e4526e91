"""Similarity of texts: word error rate, indel ratio, near duplicates by word shingles, choice among takes."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X

# Dutch number words and sounds that don't count as words.
NUMBER_WORDS = {"nul": "0", "een": "1", "twee": "2", "drie": "3", "vier": "4", "vijf": "5", "zes": "6", "zeven": "7", "acht": "8", "negen": "9", "tien": "10", "elf": "11", "twaalf": "12", "twintig": "20", "dertig": "30", "veertig": "40", "vijftig": "50", "honderd": "100", "duizend": "1000"}
SOUNDS = {"eh", "uh", "hm", "mm"}
SHINGLE_WORDS, SHINGLE_SIMILARITY = 5, 0.8
#: Counters of shingles and bits of the filter of shared ones, as powers of two; more shingles than these share them, which costs time only.
RARITY_BITS, SHARED_BITS = 24, 26


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters with marks and what they are without, then the marks themselves, which have no counterpart and so go."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFKD", chr(c))) > 1]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


_WITH_MARKS, _WITHOUT = _plain_letters()


def spoken_words(text: Column, glossary: list[tuple[str, str]] | None = None) -> Column:
    """Words as a recogniser would write them, as an array column: one token for every glossary surface and its spoken form (the
    longest first), no accents, no punctuation, number words as digits, no hesitations.

    glossary: (surface, spoken) pairs of one lexicon, which is small.
    """
    out = F.lower(text)
    for surface, spoken in sorted(glossary or [], key=lambda e: (-len(e[0]), e[0].lower())):
        token = f" {re.sub('[^a-z0-9]+', '', surface.lower())} "
        for form in {surface.lower(), spoken.lower()} - {""}:
            out = F.regexp_replace(out, f"{X.BEFORE}{re.escape(form)}{X.AFTER}", token)
    plain = F.translate(out, _WITH_MARKS, _WITHOUT)
    digits = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    tokens = F.filter(F.split(F.regexp_replace(plain, f"[^{X.WORD[1:-2]}]+", " "), " "), lambda w: (w != "") & ~w.isin(*SOUNDS))
    return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(digits, w), w))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two sequences, one row of the table at a time."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def error_rate(a: list[str], b: list[str]) -> float:
    """Errors per word of a; an empty reference gives 0 against nothing and 1 against anything."""
    return edit_distance(a, b) / len(a) if a else float(bool(b))


@F.pandas_udf(T.DoubleType())
def _error_rate(reference: pd.Series, heard: pd.Series) -> pd.Series:
    return pd.Series([error_rate(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(reference, heard)], dtype="float64")


def word_error_rate(reference: str | Column, heard: str | Column, glossary: list[tuple[str, str]] | None = None) -> Column:
    """Word error rate of two texts; a null text is an empty one. Only the comparison of differing texts leaves the JVM."""
    a, b = (spoken_words(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), glossary) for c in (reference, heard))
    return F.when(a == b, 0.0).otherwise(_error_rate(a, b))


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths; bit-parallel over machine words of any width."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    state = (1 << len(a)) - 1
    full = state
    for c in b:
        hit = places.get(c, 0)
        u = state & hit
        state = ((state + u) | (state - u)) & full
    common = len(a) - state.bit_count()
    return 200.0 * common / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte: exact up to 127, then four steps for each doubling."""
    return np.where(counts < 128, counts, np.minimum(255, 128 + 4 * np.log2(np.maximum(counts, 128) / 128))).astype(np.uint8)


def _counted(sets: DataFrame, slices: int = 64) -> np.ndarray:
    """How often each shingle is used, counted by its low bits in RARITY_BITS: never less than it is, more where shingles share a counter.

    A task sends its counters compressed, slices are added up by the executors, and the driver gets a byte a counter.
    """
    width = (1 << RARITY_BITS) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slices * width, dtype=np.uint16)
        for batch in batches:
            used, n = np.unique(batch.column(0).flatten().to_numpy() & (slices * width - 1), return_counts=True)
            counts[used] = np.minimum(counts[used] + n, 65535)
        for k, part in enumerate(counts.reshape(slices, width)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for counts in part["counts"]:
            total += np.frombuffer(zlib.decompress(counts), dtype=np.uint16)
        return pd.DataFrame({"slice": [key[0]], "counts": [zlib.compress(_levels(total).tobytes(), 1)]})

    schema = "slice int, counts binary"
    out = np.zeros(slices * width, dtype=np.uint8)
    for row in sets.select("set").mapInArrow(count, schema).groupBy("slice").applyInPandas(add, schema).toLocalIterator():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(row["counts"])), dtype=np.uint8)
    return out


def _marked(hashes: DataFrame, slices: int = 64) -> np.ndarray:
    """Bits of SHARED_BITS, set for each hash of hashes(s): a filter that lets through every one of them and few others."""
    width = (1 << SHARED_BITS) // slices

    def mark(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width, dtype=bool)
        bits[part["at"].to_numpy()] = True
        return pd.DataFrame({"slice": [key[0]], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    low = F.col("s").bitwiseAND(F.lit(slices * width - 1))
    places = hashes.select(F.floor(low / width).cast("int").alias("slice"), (low % width).cast("int").alias("at"))
    out = np.zeros(slices * width // 8, dtype=np.uint8)
    for row in places.groupBy("slice").applyInPandas(mark, "slice int, bits binary").toLocalIterator():
        out[row["slice"] * width // 8 : (row["slice"] + 1) * width // 8] = np.frombuffer(zlib.decompress(bytes(row["bits"])), dtype=np.uint8)
    return out


def _prefixes(batch: pa.RecordBatch, levels: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(row, shingle, level, set's size, place, whether in the prefix) of all shingles of a batch's sets, each set in the order of level and hash; the prefix is its first n - ceil(s n) + 1."""
    sets = batch.column(batch.schema.get_field_index("set"))
    values = sets.flatten().to_numpy()
    n = np.diff(sets.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    level = levels[values & (len(levels) - 1)]
    order = np.lexsort((values, level, row))
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    most = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    return row, values[order], level[order], n[row], place, place < most[row]


def _digest(key: str | Column) -> Column:
    return F.unhex(F.md5(key))


def near_links(keys: DataFrame, similarity: float = SHINGLE_SIMILARITY) -> DataFrame:
    """(id, links): for keys(key), flat texts in any number of copies, the MD5 digest of each that has links and how many different keys its five-word shingles overlap with by the similarity.

    Pairs are found by prefix filtering: with shingles in one order, two sets of Jaccard similarity s share one of the first
    n - ceil(s n) + 1 of each. Any order gives the same pairs; by rarity there are few candidates, so shingles are ordered by counts that are
    kept in a fixed number of counters. Three passes over the texts, which are never shuffled: the counts; the prefixes' shingles with size
    and place, which bound what two texts can have in common; the sets, sent once for each shingle by which the bound is met. A pair is compared where its first common shingle is,
    so that pairs are neither stored nor made distinct.
    """
    spark = keys.sparkSession
    last = F.size("w") - SHINGLE_WORDS
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, SHINGLE_WORDS), " "))))
    sets = keys.select("key", F.split("key", " ").alias("w")).where(F.size("w") >= SHINGLE_WORDS).select("key", shingles.alias("set"))
    levels = spark.sparkContext.broadcast(_counted(sets))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, s, level, n, place, inside = _prefixes(batch, levels.value, similarity)
            inside &= level > 1  # a shingle that was counted once is in one text only
            yield pa.RecordBatch.from_pydict({"s": s[inside], "text": batch.column(0).to_numpy()[row[inside]], "n": n[inside].astype(np.int32), "place": place[inside].astype(np.int32)})

    hashed = sets.select(F.xxhash64("key").alias("text"), "set")
    first = hashed.mapInArrow(heads, "s long, text long, n int, place int").repartition("s").distinct()
    a, b = first.alias("a"), first.hint("merge").alias("b")
    total = F.col("a.n") + F.col("b.n")
    most = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"), "a.n", "b.n")  # in common, if s is the first
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.text") < F.col("b.text")) & (most * (1 + similarity) >= similarity * total - 1e-9))
    bits = spark.sparkContext.broadcast(_marked(pairs.select("a.s", F.explode(F.array("a.text", "b.text")).alias("text")).select(F.col("s").bitwiseXOR(F.col("text")).alias("s"))))

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, s, _, _, _, inside = _prefixes(batch, levels.value, similarity)
            low = (s ^ batch.column(1).to_numpy()[row]) & (8 * len(bits.value) - 1)
            inside &= (bits.value[low >> 3] >> (7 - (low & 7)) & 1).astype(bool)
            ordered = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32), pa.array(s))
            at = pa.array(row[inside])
            for k in range(0, len(at), 10_000):
                part = at.slice(k, 10_000)
                yield pa.RecordBatch.from_pydict({"s": s[inside][k : k + 10_000], "id": batch.column(0).take(part), "set": ordered.take(part)})

    entries = sets.select(_digest("key").alias("id"), F.xxhash64("key").alias("text"), "set").mapInArrow(owners, "s long, id binary, set array<long>").repartition("s").dropDuplicates(["s", "id"])
    a, b = entries.alias("a"), entries.hint("merge").alias("b")
    n, m = F.size("a.set"), F.size("b.set")
    ahead = (F.col("a.id") < F.col("b.id")) & (n >= similarity * m - 1e-9) & (m >= similarity * n - 1e-9)
    near = a.join(b, F.col("a.s") == F.col("b.s")).select("a.s", F.col("a.id").alias("x"), F.col("b.id").alias("y"), (n + m).alias("sum"), F.when(ahead, F.array_intersect("a.set", "b.set")).alias("both"))
    linked = near.where((F.get("both", F.lit(0)) == F.col("s")) & (F.size("both") >= similarity * (F.col("sum") - F.size("both")) - 1e-9))
    return linked.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))


def near_duplicates(lines: DataFrame, similarity: float = SHINGLE_SIMILARITY) -> DataFrame:
    """(key, copies, links): distinct keys of texts with their number of rows and of different keys that are near_links."""
    keys = lines.select(X.flat(F.col("text")).alias("key")).where("key <> ''")
    keyed = keys.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).withColumn("id", _digest("key"))
    return keyed.join(near_links(keys, similarity), "id", "left").select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_digests(raw: DataFrame, key: list[str], similarity: float = SHINGLE_SIMILARITY) -> DataFrame:
    """``near_duplicates`` of raw(*key, text), repeated rows once, with the keys' MD5 digests in hexadecimal: only digests are shuffled, no texts."""
    flat = raw.select(*key, X.flat(F.col("text")).alias("key")).where("key <> ''")
    once = flat.select(*key, _digest("key").alias("id")).repartition("id").distinct()
    keyed = once.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return keyed.join(near_links(flat.select("key"), similarity), "id", "left").select(F.lower(F.hex("id")).alias("key"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def revision_word_errors(lines: DataFrame) -> DataFrame:
    """Word error rate of each line between an episode's first and last revision."""
    ends = lines.groupBy("book_id", "episode_id").agg(F.min("revision").alias("lo"), F.max("revision").alias("hi")).where("lo < hi")
    both = lines.join(ends, ["book_id", "episode_id"])
    old = both.where("revision = lo").select("book_id", "episode_id", "line_id", F.col("text").alias("old"))
    new = both.where("revision = hi").select("book_id", "episode_id", "line_id", F.col("text").alias("new"))
    return old.join(new, ["book_id", "episode_id", "line_id"]).select("book_id", "episode_id", "line_id", F.bround(word_error_rate("old", "new"), 4).alias("wer"), F.bround(ratio("old", "new"), 2).alias("ratio"))


def chosen_takes(takes: DataFrame, most_errors: float = 0.05) -> DataFrame:
    """takes(turn, take, wer, duration, target) -> the accepted take nearest to the target length, else the one with the fewest errors, flagged.

    An unknown error rate is accepted; without any accepted take it counts as 1. Ties go to the lower take number.
    """
    ok = F.col("wer").isNull() | (F.col("wer") <= most_errors)
    best = takes.groupBy("turn").agg(F.min(F.when(ok, F.struct(F.abs(F.col("duration") - F.col("target")).alias("off"), "take"))).alias("good"), F.min(F.struct(F.coalesce("wer", F.lit(1.0)).alias("e"), "take")).alias("least"), F.count(F.lit(1)).alias("takes"))
    return best.select("turn", F.coalesce("good.take", "least.take").alias("take"), F.col("good").isNull().alias("flagged"), "takes")
