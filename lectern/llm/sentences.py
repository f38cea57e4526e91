"""Problem 6: sentence boundaries across languages and scripts.

Method: a hidden-event n-gram model. Between two words stands a hidden event, boundary or none. Counts of words beside certain
events (paragraph ends, unmistakable marks, lower-case continuations) over the whole collection give each open place its odds;
forward-backward over the places of a paragraph, with a penalty for sentences of one word, gives the posterior that decides.

Null and empty texts have no units; repeated rows count once; a text without any mark is one unit per paragraph; running headers
and page numbers are skipped and a paragraph goes on across them; a table block is one unit; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import lines as L
from lectern.session import bounded_arrow_batches, ensure_checkpoint_dir
from lectern.sources.tables import table

# Abbreviations that often end a sentence, so that they say nothing about the event after them.
OPEN_ENDED = {"enz", "etc", "usw", "д", "κ.λπ", "κτλ", "jr", "e.a"}
CLOSERS = "\"'”’“»›)\\]】」』）》〉"
OPENERS = "\"'“‘„«‹(\\[¿¡（「『《\\-—–"
_THAI = "฀-๿"
_WIDE = "぀-ヿ㐀-鿿豈-﫿，、；：（「『《"
_SITE = re.compile(f"[。！？]+[…。！？]*[\"'”’»)\\]】」』）》〉]*|(?:[.!?…؟۔।॥]+|(?<=[Ͱ-Ͽἀ-῿»])[;;])(?:[{CLOSERS}]|\\s[»](?=[\\s,.]|$))*\\.?")
_SPACE_IN_THAI = re.compile(f"(?<=[{_THAI}\"0-9])[^\\S\\n]+(?=[{_THAI}\"0-9])")
_PARA = re.compile("\\n[^\\S\\n]*\\n\\s*")
_TOKEN = re.compile("\\S+")
_INITIAL = re.compile("[^\\w]*[A-Z]")
_NUM = re.compile("\\d+(?:[.,]\\d+)*")
_LEFT_TRIM, _RIGHT_TRIM = re.compile(f"^[{OPENERS}{CLOSERS}]+"), re.compile(f"[{CLOSERS},;:!?…]+$")
_THAI_ANY, _WIDE_ANY = re.compile(f"[{_THAI}]"), re.compile("[぀-ヿ㐀-鿿]")

#: Statistics: (kind, token) with its count. plain: lower-case word without a dot; dot: word before a dot; low: word before a
#: dot that a lower-case word or comma follows; end: word at a paragraph's end; start: word after a certain boundary;
#: mid: capitalised word where no boundary can be; open: word after an open place.
#: A word this long without an inner dot is hardly an abbreviation, even if it is seen nowhere else.
WORDLIKE = 6
#: Stands for a single capital before a dot.
INITIAL = "<initial>"
STATS = ("plain", "dot", "low", "end", "start", "mid", "open")
CERTAIN = 30.0


def _blanked(text: str, title: str | None) -> str:
    """The text with headers and page numbers as spaces (same length), so that paragraphs go on across page breaks."""
    lines = text.split("\n")
    if len(lines) < 2:
        return text
    kinds = L.classify(lines, list(map(L.fold, lines)), L.headers_of(title))
    if L.HEADER not in kinds and L.PAGE not in kinds:
        return text
    n, out, joint = len(lines), list(lines), [False] * len(lines)
    for i, kind in enumerate(kinds):
        if kind in (L.HEADER, L.PAGE):
            out[i], joint[i] = " " * len(lines[i]), True
    for step in (1, -1):
        for i in range(n) if step > 0 else range(n - 1, -1, -1):
            if kinds[i] == L.BLANK and 0 <= i - step < n and joint[i - step]:
                joint[i] = True
    parts = [out[0]]
    for i in range(1, n):
        parts.append(" " if joint[i] or joint[i - 1] else "\n")
        parts.append(out[i])
    return "".join(parts)


#: Longer tokens (unbroken strings, texts without spaces) are counted by their first characters, so that keys stay short.
LONG_TOKEN = 64
_HEAD = re.compile(f"\\S{{1,{LONG_TOKEN + 16}}}")
_WORD_BEFORE = re.compile("[^\\s。！？，、；：]+")


def _norm(token: str) -> str:
    return _NUM.sub("#", token[:LONG_TOKEN])


def _last_word(para: str, end: int) -> str:
    """The word before a place, up to white space or a wide mark: looked for in a window that grows until it holds the word's beginning."""
    width = 48
    while True:
        low = max(0, end - width)
        words = _WORD_BEFORE.findall(para, low, end)
        if low == 0 or len(words) > 1 or words and not _WORD_BEFORE.match(para, low, low + 1):
            return words[-1] if words else ""
        width *= 8


def _right(para: str, at: int) -> tuple[str, str, str]:
    """(class, token, short token) of what follows: U, l, #, o (no case), C (wide script, no space), p (continuing mark), '' (end)."""
    m = _HEAD.search(para, at)
    if not m:
        return "", "", ""
    raw = m.group()
    word = _LEFT_TRIM.sub("", raw)
    if not word:
        nxt = _HEAD.search(para, m.end())
        word = _LEFT_TRIM.sub("", nxt.group()) if nxt else ""
    if raw[0] in ",;:)]}»”，、；：" or raw[0] in "·":
        return "p", word, word
    if word[:1] and _WIDE_ANY.match(word):
        return "C", _norm(word[:6])[:3], _norm(word[:6])[:2]
    if raw[:2] in ("'s", "'t", "’s", "’t", "'n", "’n", "'k") and len(raw) <= 2:
        nxt = _HEAD.search(para, m.end())
        word = nxt.group() if nxt else word
        return ("U" if word[:1].isupper() else "l"), raw, raw
    word = _RIGHT_TRIM.sub("", word)
    first = word[:1]
    kind = "#" if first.isdigit() else "U" if first.isupper() else "l" if first.islower() else "o"
    if kind == "U" and len(word) <= 2 and word.endswith("."):
        kind = "I"
    word = word.rstrip(".")
    return kind, _norm(word), _norm(word)


def parse(text: str, title: str | None, stats: Counter) -> list[tuple[int, int, int, str, str, str, str, float]]:
    """Places of one text: (paragraph, end_pos, words since the last place, left, right, short right, class, fixed odds or 0)."""
    shown = _blanked(text, title)
    places: list[tuple[int, int, int, str, str, str, str, float]] = []
    cuts = [(m.start(), m.end()) for m in _PARA.finditer(shown)]
    starts, stops = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(shown)]
    for no, (a, b) in enumerate(zip(starts, stops)):
        para = shown[a:b].rstrip()
        lead = len(para) - len(para.lstrip())
        if not para.strip():
            continue
        end = a + len(para)
        rows = para.strip().split("\n")
        if rows[0].strip() == "[tabel]" or any(" | " in x for x in rows) and all(" | " in x or _norm(x.strip()) == "#" for x in rows):
            places.append((no, end, 1, "", "", "", "T", CERTAIN))
            continue
        _, token, _ = _right(para, lead)
        stats["start", token] += 1
        found = [(m.start(), m.end(), m.group()) for m in _SITE.finditer(para)]
        if _THAI_ANY.search(para):
            found = sorted(found + [(m.start(), m.start(), " ") for m in _SPACE_IN_THAI.finditer(para)])
        tokens = para.split()
        _count_words(tokens, stats)
        before = lead
        for start, stop, mark in found:
            if stop >= len(para):
                break
            gap = para[stop]
            spaced = gap.isspace() or mark == " "
            wide = mark[0] in "。！？" or mark[0] == "…" and _WIDE_ANY.match(gap) is not None
            if not spaced and not wide:
                continue
            kind, token, short = _right(para, stop)
            token_left = _last_word(para, start)
            left = _norm(_LEFT_TRIM.sub("", _RIGHT_TRIM.sub("", token_left)).lower())
            closed = any(c in "\"”’“»」』" for c in mark[1:])
            if kind == "#" and mark == "." and token_left.startswith("(") and ")" not in token_left:
                continue  # a number inside a bracket, as in (no. 13)
            if _INITIAL.fullmatch(token_left):
                left = INITIAL
            odds = _certain(mark, kind, closed, wide, left, stats, token)
            if odds is None:
                continue
            if odds >= CERTAIN:
                stats["start", token] += 1
            elif odds == 0:
                stats["open", token] += 1
            words = len(para[before:start].split())
            places.append((no, a + stop, words, left, token, short, ("W" if wide or kind in "Co" else "A") + kind + ("." if mark[0] == "." and not closed else mark[0]), odds))
            before = stop
        last = tokens[-1]
        if last.endswith(".") and not last.endswith(".."):
            stats["end", _norm(_LEFT_TRIM.sub("", last.rstrip(".")).lower())] += 1
        places.append((no, end, max(2, len(para[before:].split())), "", "", "", "E", CERTAIN))
    return places


def _certain(mark: str, kind: str, closed: bool, wide: bool, left: str, stats: Counter, token: str) -> float | None:
    """Odds that the marks alone settle; 0 where the model decides; None where no boundary can be."""
    if kind == "p":
        if mark == ".":
            stats["low", left] += 1
        return None
    if mark == " ":
        return CERTAIN
    if mark == ".":
        stats["dot", left] += 1
    if kind == "l":
        if mark == ".":
            stats["low", left] += 1
        return None
    if wide or kind in "Co":
        if mark[0] == "…":
            return 0.0
        if mark[0] == ".":
            return 0.0
        return 0.0 if closed else CERTAIN
    if mark[0] == "." and not closed and len(mark) == 1:
        return 0.0
    if mark[0] == "…" or mark.startswith(".."):
        return CERTAIN / 4 if kind in "UI" else 2.0
    return CERTAIN


def _count_words(tokens: list[str], stats: Counter) -> None:
    """Plain words, and capitalised words after a word without any mark."""
    previous = ""
    for token in tokens:
        if len(token) > LONG_TOKEN:
            token = token[:LONG_TOKEN]
        last = previous[-1:]
        first = token[0]
        if first.isalpha():
            if token[-1].isalpha() and first.islower():
                stats["plain", token] += 1
            elif first.isupper() and (last.isalnum() or last == ","):
                stats["mid", token.rstrip(".,;:!?")] += 1
                if token[-1].isalpha():
                    stats["plain", token.lower()] += 1
            elif first.islower() and token[-1] in ",;:":
                stats["plain", token[:-1]] += 1
        previous = token


_ROW = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("token", T.StringType()), T.StructField("n", T.LongType()), T.StructField("book_id", T.StringType()), T.StructField("section_id", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("para", "end_pos", "words")]
    + [T.StructField(c, T.StringType()) for c in ("left", "right", "short", "cls")]
    + [T.StructField("odds", T.DoubleType())]
)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_ROW.fieldNames())
    for c in ("para", "end_pos", "words", "n"):
        out[c] = out[c].astype("Int64")
    return out


def _counted(stats: Counter) -> pd.DataFrame:
    rows = [(kind, token, n, None, None, None, None, None, None, None, None, None, None) for (kind, token), n in stats.items() if token]
    stats.clear()
    return _frame(rows)


#: Different words and kinds that a task adds up before it writes their counts.
HELD_COUNTS = 300_000


def _parse_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stats: Counter = Counter()
    for part in parts:
        yield _frame([("place", None, None, book, section, *p) for book, section, text, title in zip(part["book_id"], part["section_id"], part["text"], part["title"]) for p in parse(text, title, stats)])
        if len(stats) > HELD_COUNTS:
            yield _counted(stats)
    yield _counted(stats)


def places_and_stats(sections: DataFrame, books: DataFrame) -> DataFrame:
    """One pass over the texts: places as rows of kind 'place', statistics added up per task; kept in the checkpoint folder."""
    spark = sections.sparkSession
    ensure_checkpoint_dir(spark)
    bounded_arrow_batches(spark)
    titles = books.groupBy("book_id").agg(F.max("title").alias("title"))
    texts = sections.where("text is not null and trim(text) <> ''").select("book_id", "section_id", "text").join(titles, "book_id", "left")
    return texts.select("book_id", "section_id", "text", "title").mapInPandas(_parse_all, _ROW).checkpoint()


def model_odds(stats: DataFrame, places: DataFrame) -> DataFrame:
    """Open places with their odds (logarithms) from the counts of the words beside them."""
    wide = stats.groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in STATS])
    left = wide.select(F.col("token").alias("left"), *[F.col(k).alias(f"l_{k}") for k in ("plain", "dot", "low", "end")])
    right = wide.select(F.col("token").alias("right"), *[F.col(k).alias(f"r_{k}") for k in ("start", "mid", "open")])
    lower = wide.select(F.col("token").alias("lowered"), F.col("plain").alias("w_plain"))
    short = stats.where("kind = 'start'").groupBy(F.substring("token", 1, 2).alias("short")).agg(F.sum("n").alias("s_start"))
    open_ = places.where("odds = 0").withColumn("lowered", F.lower("right"))
    all_ = open_.join(left, "left", "left").join(right, "right", "left").join(lower, "lowered", "left").join(short, "short", "left").na.fill(0)
    log = F.log
    is_number, initial = F.col("left").rlike("^#"), F.col("left") == INITIAL
    unknown = (F.col("l_plain") + F.col("l_end")) < 0.05 * F.col("l_dot")
    wordlike = (F.length("left") >= WORDLIKE) & ~F.col("left").contains(".")
    seen = log((F.col("l_plain") + 5 * F.col("l_end") + F.when(wordlike, 2.5).otherwise(0.5)) / (5 * F.col("l_low") + F.when(unknown & ~wordlike, F.col("l_dot")).otherwise(0) + 0.5))
    left_odds = F.when(F.col("left").isin(*OPEN_ENDED), 0.0).when(is_number, F.lit(0.0)).when(initial, -12.0).otherwise(F.greatest(F.lit(-7.0), F.least(seen, F.lit(7.0))))
    opened = F.when(F.col("left").isin(*OPEN_ENDED), F.col("r_open")).otherwise(0)
    cased = log((F.col("r_start") + F.col("w_plain") + opened + 0.5) / (2 * F.col("r_mid") + 0.5))
    kind = F.substring("cls", 2, 1)
    right_odds = F.when(kind == "I", -6.0).when(kind == "#", F.when(is_number, -1.0).otherwise(0.0)).when(kind == "U", F.greatest(F.lit(-5.0), F.least(cased, F.lit(5.0))))
    plain = left_odds + right_odds + F.when(is_number & (kind == "U") & (F.col("r_start") + F.col("w_plain") == 0), -1.5).otherwise(0.0)
    begins = F.when(F.col("r_start") > 0, 4.0 + log(F.col("r_start") / 2.0)).when((F.col("r_open") < 2) & (F.col("s_start") > 0), 1.0).otherwise(-4.0)
    dotted = F.when(F.col("cls").endswith("."), F.least(F.lit(3.0), left_odds) + F.when(F.col("r_start") > 0, 3.0).otherwise(1.0)).otherwise(begins)
    return all_.withColumn("odds", F.when(F.col("cls").startswith("W"), dotted).otherwise(plain)).select(*places.columns)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _decided(paragraphs: pd.Series) -> pd.Series:
    return pd.Series([decide(p) for p in paragraphs])


#: Logarithm of how much less likely a sentence of one word is than longer ones.
ONE_WORD = -3.0


def decide(places: list) -> list[int]:
    """Ends of sentences: places whose posterior of a boundary, by forward-backward over the paragraph, is above one half."""
    rows = sorted(((p["end_pos"], p["words"], p["odds"]) for p in places))
    n = len(rows)
    forward: list[tuple[float, float]] = []
    short = [ONE_WORD if w <= 1 and abs(o) < CERTAIN else 0.0 for _, w, o in rows]

    def add(a: float, b: float) -> float:
        top = max(a, b)
        return top + math.log(math.exp(a - top) + math.exp(b - top))

    none, cut = 0.0, 0.0
    for i, (_, _, odds) in enumerate(rows):
        if i == 0:
            none, cut = 0.0, odds
        else:
            none, cut = add(none, cut), odds + add(none, cut + short[i])
        top = max(none, cut)
        none, cut = none - top, cut - top
        forward.append((none, cut))
    back_none, back_cut, ends = 0.0, 0.0, []
    for i in range(n - 1, -1, -1):
        if forward[i][1] + back_cut > forward[i][0] + back_none:
            ends.append(rows[i][0])
        odds = rows[i][2]
        back_none, back_cut = add(back_none, odds + back_cut), add(back_none, odds + short[i] + back_cut)
        top = max(back_none, back_cut)
        back_none, back_cut = back_none - top, back_cut - top
    return ends[::-1]


def sentence_ends(sections: DataFrame, books: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(book_id, section_id, end_pos), one row per sentence; distinct, so that repeated rows count once.

    only: keys of the sections to return; the statistics are of all sections in any case.
    """
    rows = places_and_stats(sections, books)
    places = rows.where("kind = 'place'").select("book_id", "section_id", "para", "end_pos", "words", "left", "right", "short", "cls", "odds")
    if only is not None:
        places = places.join(only.select("book_id", "section_id").distinct(), ["book_id", "section_id"], "left_semi")
    settled = places.where("odds <> 0").unionByName(model_odds(rows.where("kind <> 'place'"), places))
    grouped = settled.groupBy("book_id", "section_id", "para").agg(F.collect_set(F.struct("end_pos", "words", "odds")).alias("places"))
    return grouped.select("book_id", "section_id", F.explode(_decided("places")).alias("end_pos"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of all sections by their end."""
    return sentence_ends(table(spark, folder, "sections"), table(spark, folder, "books").select("book_id", "title"))


def p6_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units with their place and text (line feeds and skipped lines included as stored)."""
    sections = table(spark, folder, "sections").where("text is not null").select("book_id", "section_id", "text").dropDuplicates(["book_id", "section_id"])
    ends = p6_found(spark, folder).groupBy("book_id", "section_id").agg(F.array_sort(F.collect_list("end_pos")).alias("ends"))
    spans = F.transform("ends", lambda e, i: F.struct(F.coalesce(F.get("ends", i - 1), F.lit(0)).alias("start_pos"), e.alias("end_pos")))
    each = sections.join(ends, ["book_id", "section_id"]).select("book_id", "section_id", "text", F.explode(spans).alias("s"))
    return each.select("book_id", "section_id", "s.start_pos", "s.end_pos", F.trim(F.substring("text", F.col("s.start_pos") + 1, F.col("s.end_pos") - F.col("s.start_pos")), F.lit(" \n\t")).alias("sentence"))
