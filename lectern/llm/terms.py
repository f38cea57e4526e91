"""Problem 4: how often every distinct term occurs and in how many records, with a mark for too rare or too common.

Method: an external sort. (term, record) pairs are counted as runs of sorted words inside each record, range-partitioned by term
and record, sorted inside each range and scanned: equal neighbours are one run, whose length counts occurrences and distinct
records. A hot term is spread over several ranges because the record is part of the range key; its partial runs are added up.

Null and empty texts have no terms but count as records; a row repeated in full is the same (term, record) run and counts once;
other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import kept
from lectern.sources.tables import table

#: Fixed value: a word of at least three letters, as the task states it.
WORD = "[A-Za-zÀ-ÖØ-öø-ſ]{3,}"


@F.pandas_udf(T.StringType())
def _folded(surfaces: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in surfaces:
        yield part.map(lambda s: s.strip().casefold() if isinstance(s, str) else None)


_RUNS = "field string, term string, occurrences long, records long"


def _scan_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of one sorted range: the run that is open at a batch's end is carried into the next batch."""
    held: tuple | None = None  # (field, term, record, n of the open pair, occurrences and records of the term so far)
    names = ["field", "term", "occurrences", "records"]
    for part in parts:
        if not part.num_rows:
            continue
        field, term, record = (np.asarray(part.column(k).to_numpy(zero_copy_only=False), dtype=object) for k in (0, 1, 2))
        n = part.column(3).to_numpy(zero_copy_only=False)
        new_term = np.ones(len(n), dtype=bool)
        new_term[1:] = (term[1:] != term[:-1]) | (field[1:] != field[:-1])
        new_pair = new_term.copy()
        new_pair[1:] |= record[1:] != record[:-1]
        heads = np.flatnonzero(new_pair)
        most = np.maximum.reduceat(n, heads)  # equal pairs are one run
        firsts = np.flatnonzero(new_term[heads])
        occurrences, records = np.add.reduceat(most, firsts), np.diff(np.append(firsts, len(heads)))
        at = heads[firsts]
        rows = [[field[i], term[i], int(o), int(r)] for i, o, r in zip(at, occurrences, records)]
        if held and held[0] == rows[0][0] and held[1] == rows[0][1]:
            first_pair = int(most[0])
            rows[0][2] += held[4]
            rows[0][3] += held[5]
            if held[2] == record[0]:  # the pair itself goes on
                rows[0][2] -= min(held[3], first_pair)
                rows[0][3] -= 1
        elif held:
            rows.insert(0, [held[0], held[1], held[4], held[5]])
        last = rows.pop()
        tail = int(most[-1]) if len(heads) > 1 or not held or held[2] != record[0] or held[1] != term[0] else max(held[3], int(most[-1]))
        held = (last[0], last[1], record[-1], tail, last[2], last[3])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((held[0], held[1], held[4], held[5]), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)


def run_length_counts(pairs: DataFrame) -> DataFrame:
    """pairs(field, term, record, n) -> (field, term, occurrences, records).

    n is the count of the term in the record; equal (term, record) pairs are one run with the largest n. The pairs are kept, so
    that drawing the ranges' bounds doesn't make them anew.
    """
    spread = kept(pairs.select("field", "term", "record", "n")).repartitionByRange("term", "field", "record").sortWithinPartitions("term", "field", "record")
    return spread.mapInArrow(_scan_runs, _RUNS).groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _record(*keys: str) -> Column:
    """One identifier of a record; parts can't run into one another, a null part stays apart from an empty one."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(k), F.lit("\x1e")) for k in keys]).alias("record")


def section_pairs(sections: DataFrame) -> DataFrame:
    """Terms of each text with their count there (runs of its sorted words); the text itself is never shuffled."""
    words = F.array_sort(F.transform(F.expr(f"regexp_extract_all(text, '({WORD})', 1)"), F.lower))
    each = sections.where("text is not null").select("book_id", "section_id", words.alias("words")).where("size(words) > 0")
    starts = F.expr("filter(sequence(0, size(words) - 1), i -> i = 0 or words[i] <> words[i - 1])")
    runs = F.expr("transform(starts, (p, k) -> struct(words[p] as term, coalesce(get(starts, k + 1), size(words)) - p as n))")
    counted = each.withColumn("starts", starts).select("book_id", "section_id", F.explode(runs).alias("x"))
    return counted.select(F.lit("sections.text").alias("field"), "x.term", _record("book_id", "section_id"), F.col("x.n").cast("long").alias("n"))


def lexicon_pairs(lexicon: DataFrame) -> DataFrame:
    """Folded surfaces with the book that holds them; n counts the rows that aren't word-for-word repeats."""
    rows = lexicon.distinct().select("book_id", _folded("surface").alias("term")).where("term <> ''")
    return rows.groupBy("term", "book_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lexicon.surface").alias("field"), "term", _record("book_id"), "n")


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(field, term, occurrences, records, total, mark): all terms; mark is null between the bounds."""
    sections, lexicon = table(spark, folder, "sections"), table(spark, folder, "lexicon")
    pairs = section_pairs(sections).unionByName(lexicon_pairs(lexicon))
    counts = run_length_counts(pairs)
    total_s = sections.select("book_id", "section_id").distinct().agg(F.count(F.lit(1)).alias("total")).select(F.lit("sections.text").alias("field"), "total", F.lit(0.20).alias("share"))
    total_l = lexicon.select("book_id").distinct().agg(F.count(F.lit(1)).alias("total")).select(F.lit("lexicon.surface").alias("field"), "total", F.lit(0.25).alias("share"))
    totals = total_s.unionByName(total_l)  # two rows
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > F.col("share") * F.col("total"), "common")
    return counts.join(F.broadcast(totals), "field").select("field", "term", "occurrences", "records", "total", mark.alias("mark"))


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its counts and mark."""
    return term_counts(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return term_counts(spark, folder).where("mark is not null").select("field", "term", "mark")


_COUNTS_SQL = r"""
with s as (select distinct book_id, section_id, text from sections),
w as (select book_id, section_id, lower(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]{3,}'))) as term from s),
l as (select distinct * from lexicon),
f as (select replace(lower(trim(surface, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), 'ß', 'ss') as term, book_id from l),
c as (select 'sections.text' as field, term, count(*) as occurrences, count(distinct (book_id, section_id)) as records,
       (select count(distinct (book_id, section_id)) from sections) as total, 0.20 as share from w group by term
  union all
  select 'lexicon.surface', term, count(*), count(distinct book_id), (select count(distinct book_id) from lexicon), 0.25 from f where term <> '' group by term)
select field, term, occurrences, records, total,
  case when records = 1 then 'rare' when records > share * total then 'common' end as mark from c
"""
P4_TERMS_SQL = _COUNTS_SQL
P4_FOUND_SQL = f"select field, term, mark from ({_COUNTS_SQL}) where mark is not null"
