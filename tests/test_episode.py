"""Timelines, blocks, parts, outlines, cutting, cues and copies: literal cases and plain simulations."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import cues as C
from lectern.operators import audit as A
from lectern.operators import copies as K
from lectern.operators import cutting as B
from lectern.operators import episode as E
from lectern.operators import folds as W
from lectern.operators import matching as M
from lectern.operators import script as S
from lectern.operators import transcript as N
from lectern.plans import episode_queries as Q
from lectern.sources.tables import table

TURN = "book_id string, episode_id string, revision int, turn_no long, speaker string, seg_no int, mode string, target string, cut_word string, line_ids array<string>, tags array<string>, reaction string, text string, pause_s double, duration_s double, timing_gap_s double, words array<struct<word: string, start_s: double>>"


def turn(no, speaker, mode="none", target=None, seg=1, pause=0.0, text="een gewone zin van meer dan zes woorden hier", length=4.0, cut=None, timed=None, tags=(), words=()):
    return ("b", "e", 1, no, speaker, seg, mode, target, cut, [f"l{no}"], list(tags), None, text, pause, length, timed, list(words))


def placed(spark, turns):
    return {r["turn_no"]: r for r in W.timeline(spark.createDataFrame(turns, TURN)).collect()}


def test_timeline(spark):
    words = [("de", 0.0), ("dijk", 1.0), ("houdt", 2.0), ("dijk", 2.6), ("stand", 3.2)]
    got = placed(spark, [
        turn(1, "a", words=words, pause=0.5),
        turn(2, "b", "interrupt", "l1", cut="Dijk,", length=2.0),
        turn(3, "a", "backchannel", "l2", length=0.5),
        turn(4, "c", "backchannel", "l3", length=0.5),  # its target lies inside another turn
        turn(5, "b", seg=2, pause=2.0),
        turn(6, "a", timed=-0.05, text="Ja?", length=1.0, seg=2),
        turn(7, "b", "interrupt", "l1", seg=2),  # not the turn before
        turn(8, "a", seg=2),
    ])
    assert got[1]["start_s"] == 0 and got[2]["transition"] == "interrupt" and got[2]["start_s"] == pytest.approx(2.6 - 0.25)
    assert 3.0 <= got[1]["cut_s"] <= 3.2 and got[1]["duck_db"] == 12.0 and got[1]["duck_s"] == got[2]["start_s"] and got[1]["end_s"] == pytest.approx(got[1]["cut_s"] + 0.12)
    assert got[3]["transition"] == "backchannel" and got[3]["start_s"] == pytest.approx(got[2]["start_s"] + 0.6 * 2.0)
    assert got[4]["transition"] in ("plain", "quick") and got[4]["ignored"] and got[4]["start_s"] >= got[2]["end_s"] - 0.06
    assert got[5]["transition"] == "segment" and 0.6 <= got[5]["start_s"] - got[4]["end_s"] <= 0.9
    assert got[6]["transition"] == "timed" and got[6]["start_s"] == pytest.approx(got[5]["end_s"] + 2.0 - 0.05) and got[5]["deliberate_s"] == pytest.approx(1.95)
    assert got[7]["transition"] == "quick" and got[7]["ignored"] and got[8]["transition"] == "plain"
    gaps = W.unwritten_gaps(W.timeline(spark.createDataFrame([turn(1, "a", pause=2.0), turn(2, "b")], TURN)), 1.2)
    assert gaps.count() == 0  # the pause is written
    quiet = W.timeline(spark.createDataFrame([turn(1, "a"), turn(2, "b")], TURN)).withColumn("start_s", F.col("start_s") + 3 * (F.col("turn_no") - 1))
    assert [r["turn_no"] for r in W.unwritten_gaps(quiet).collect()] == [1]


def test_accepted_backchannels_equal_a_walk(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows = [turn(i, rng.choice("abc"), rng.choice(["none", "backchannel", "backchannel"]), f"l{max(1, i - rng.choice([1, 1, 2, 3]))}") for i in range(1, 26)]
        at, inside = None, set()
        for r in rows:
            if at is not None and r[6] == "backchannel" and r[7] == f"l{at[3]}" and at[4] != r[4]:
                inside.add(r[3])
            else:
                at = r
        assert {n for n, r in placed(spark, rows).items() if r["transition"] == "backchannel"} == inside


def test_blocks_equal_a_walk():
    rng = random.Random(4)
    for _ in range(300):
        n, most = rng.randint(1, 30), 100
        sizes = np.array([rng.choice([0, 5, 20, 45, 60, 130]) for _ in range(n)])
        segment, speaker = ([True] + [rng.random() < p for _ in range(n - 1)] for p in (0.15, 0.5))
        starts = W.block_starts(sizes, np.array(segment), np.array(speaker), most)
        total = lambda a, b: int(sizes[a:b].sum())
        want, begin = [0], 0
        for i in range(1, n):
            if segment[i] and total(begin, i) >= 0.4 * most:
                begin = i
                want.append(i)
            elif total(begin, i + 1) > most:
                seams = [k for k in range(begin + 1, i) if speaker[k] and total(begin, k) >= 0.5 * most]
                last = max((k for k in range(begin + 1, i) if speaker[k]), default=0)
                if seams and seams[-1] == last:
                    begin = last
                    want.append(last)
                    if total(begin, i + 1) > most:
                        begin = i
                        want.append(i)
                else:
                    begin = i
                    want.append(i)
        assert starts == want, (sizes, segment, speaker)


def test_parts_of_sections(spark):
    rng = random.Random(5)
    texts = ["\n\n".join("x" * rng.choice([0, 3, 8, 20, 33]) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rows = [("b", "c", f"s{i:02d}", i, t) for i, t in enumerate(texts)] + [("b", "c", "null", 99, None)] + [("b", "c", "s00", 0, texts[0])]
    df = spark.createDataFrame(rows, "book_id string, chapter_id string, section_id string, section_no int, text string")
    got = {}
    for r in E.section_parts(df, 20).orderBy("section_id", "part_no").collect():
        got.setdefault(r["section_id"], []).append(r["text"])
        assert len(r["text"]) <= 20
    assert set(got) == {f"s{i:02d}" for i in range(60)}
    for i, t in enumerate(texts):
        assert "".join(got[f"s{i:02d}"]).replace("\n", "") == t.replace("\n", "")
        if len(t) <= 20:
            assert got[f"s{i:02d}"] == [t]
    readings = E.chapter_parts(df, 20).groupBy("reading_no").agg(F.sum("chars").alias("n"), F.count("*").alias("k")).collect()
    assert max(r["n"] for r in readings) <= 20 and sorted(r["reading_no"] for r in readings) == list(range(len(readings)))


def test_outline(spark):
    claims = spark.createDataFrame([("b", "c", f"c{i}", i) for i in range(1, 7)], "book_id string, chapter_id string, claim_id string, claim_no int")
    given = [("b", "c", 2, 0, "c5"), ("b", "c", 1, 0, "c4"), ("b", "c", 1, 1, "c2"), ("b", "c", 2, 1, "c4"), ("b", "c", 2, 2, "weg")]
    outline = spark.createDataFrame(given, "book_id string, chapter_id string, block_no int, place int, claim_id string")
    rows = E.outline_repaired(claims, outline).orderBy("block_no", "place").collect()
    assert [(r["block_no"], r["claim_id"]) for r in rows] == [(1, "c1"), (1, "c4"), (1, "c2"), (1, "c3"), (2, "c5"), (2, "c6")]


def test_cutting(spark):
    long = "Deze zin vult het hoofdstuk met gewone tekst. " * 8
    lines = [
        ("Voorwoord", 18.0, True, 1), ("Een kort begin.", 10.0, False, 2), ("Hoofdstuk 1 Dijken", 18.0, True, 3), ("1.1 Zand", 14.0, True, 4), (long + "bo-", 10.0, False, 5), ("dem.", 10.0, False, 5),
        ("Opdrachten", 10.0, True, 6), ("1. Schrijf op.", 10.0, False, 7), ("1.2 Klei en", 14.0, True, 8), ("leem", 14.0, True, 8), ("Korte alinea.", 10.0, False, 9), ("Nog een.", 10.0, False, 10),
        ("Hoofdstuk 2 Kort", 18.0, True, 11), ("Bijna niets.", 10.0, False, 12), ("Hoofdstuk 3 Water", 18.0, True, 13), (long, 10.0, False, 14),
    ]
    units = spark.createDataFrame([("b", i, 1 + i // 6, "line", t, s, bold, block) for i, (t, s, bold, block) in enumerate(lines)], "book_id string, idx int, page int, kind string, text string, size double, bold boolean, block_id int")
    assert [(r["book_id"], r["body"]) for r in B.body_sizes(units).collect()] == [("b", 10.0)]
    heads = [(r["idx"], r["level"], r["text"], r["span"]) for r in B.headings(units).orderBy("idx").collect()]
    assert heads == [(0, 1, "Voorwoord", 1), (2, 1, "Hoofdstuk 1 Dijken", 1), (3, 2, "1.1 Zand", 1), (6, 2, "Opdrachten", 1), (8, 2, "1.2 Klei en leem", 2), (12, 1, "Hoofdstuk 2 Kort", 1), (14, 1, "Hoofdstuk 3 Water", 1)]
    rows = B.book_sections(units, spark.createDataFrame([("b", "Boek")], "book_id string, title string")).orderBy("section_id").collect()
    assert [(r["section_id"], r["section_title"]) for r in rows] == [("ch01.1", "Zand"), ("ch01.2", "Klei en leem"), ("ch01.3", "Kort"), ("ch02.1", "Water")]
    assert rows[0]["text"].endswith("bodem.") and "Schrijf" not in rows[0]["text"] and rows[1]["text"] == "Korte alinea.\n\nNog een."
    bare = spark.createDataFrame([("b", 0, 1, "line", long, 10.0, False, 1)], units.schema)
    assert [(r["chapter_id"], r["section_id"], r["chapter_title"]) for r in B.book_sections(bare, spark.createDataFrame([("b", "Boek")], "book_id string, title string")).collect()] == [("ch01", "ch01.1", "Boek")]
    assert B.book_sections(bare.where("false"), spark.createDataFrame([("b", "Boek")], "book_id string, title string")).count() == 0


def test_cues(spark):
    rows = [("(lacht)", None, "Haha.", "laugh"), ("Nou [zucht] , dat weet ik niet.", None, "Nou, dat weet ik niet.", None), ("zacht grinniken", None, "Hehe.", "chuckle"), ("Hm-hm, ja.", "hm", "Hm-hm, ja.", "hm"), ("Haha, dat is goed.", "laugh", "Haha, dat is goed.", None), ("", None, "", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, reaction string, say string, is string")
    for r in df.select("*", C.speakable(F.col("text")).alias("got"), C.pure_reaction(F.col("text"), F.col("reaction")).alias("pure")).collect():
        assert (r["got"], r["pure"]) == (r["say"], r["is"]), r


def lines(spark, texts, covers=None):
    rows = [("b", "ch01", 1, 1, "body", k, k, f"l{k:03d}", "wende", t, covers or []) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "book_id string, episode_id string, revision int, seg_no int, seg_type string, line_no int, pos int, line_id string, speaker string, text string, covers array<string>").withColumn("mode", F.lit("none"))


def test_near_duplicates_of_a_script_equal_brute_force(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(8)]
    texts = []
    for _ in range(70):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 5, 10, 25])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    flat = [" ".join(t.split()) for t in texts]
    want = {}
    for i, t in enumerate(flat):
        twin = next((j for j in range(i) if flat[j] != t and len(flat[j]) >= 60 and M.indel_ratio(flat[j], t) >= 85), None)
        if len(t) >= 60 and twin is not None:
            want[f"l{i + 1:03d}"] = f"l{twin + 1:03d}"
    got = {r["line_id"]: r["claim_id"] for r in W.near_duplicate_lines(lines(spark, [*texts, None, "kort"])).collect()}
    assert got == want and len(want) > 20


def test_copies(spark):
    quote = "De dijk houdt het water tegen zolang de klei niet uitdroogt in de zomer."
    claims = spark.createDataFrame([("b", "ch01", "c1", quote, "Klei moet nat blijven, anders scheurt de dijk en stroomt het water erdoor."), ("b", "ch01", "c2", None, None)], "book_id string, chapter_id string, claim_id string, quote string, claim string")
    said = lines(spark, [f"Ja, {quote}", "Klei moet nat blijven; anders scheurt de dijk, en stroomt het water erdoor!", "Iets heel anders over klei en dijken in de zomer van het jaar.", None], ["c2", "c1"])
    assert {(r["line_id"], r["claim_id"]) for r in K.source_copy(said, claims).collect()} == {("l001", "c1"), ("l002", "c1")}
    samples = spark.createDataFrame([("Ja, de dijk houdt het water tegen zolang de klei niet uitdroogt in de zomers.",), (None,), ("kort",)], "text string")
    assert {r["line_id"] for r in K.sample_copy(said, samples).collect()} == {"l001"}


def test_unknown_words_and_terms(spark):
    known = spark.createDataFrame([("b", w) for w in ("water", "stand", "dijk", "bouw", "meter", "staat", "hoog")], "book_id string, word string")
    said = lines(spark, ["Waterstandsmeter staat hoog, vertrust Amsterdam. Waterbouw VEEL", "vertrust dijkbouw", None])
    assert {(r["word"], r["line_id"]) for r in N.unknown_words_by_episode(said, known).collect()} == {("vertrust", "l001")}
    over = lines(spark, ["Meet in m² of feedback.", "ja", "feedbacks", "nee"]).withColumn("mode", F.when(F.col("line_no") % 2 == 0, "backchannel").otherwise("none"))
    for c in ("tags", "pause_after_ms"):
        over = over.withColumn(c, F.lit(None))
    lexicon = spark.createDataFrame([("b", " Feedback ", "loanword_en"), ("b", "m²", "notation"), ("b", None, "notation"), ("other", "feedbacks", "notation")], "book_id string, surface string, kind string")
    assert [r["line_id"] for r in S.overlap_over_terms(over, lexicon).collect()] == ["l002"]
    segments = spark.createDataFrame([("b", "ch01", 1, 1), ("b", "ch01", 1, 2), ("b", "ch02", 1, None)], "book_id string, episode_id string, revision int, seg_no int")
    assert {(r["rule"], r["episode_id"], r["claim_id"]) for r in S.empty_rules(over, segments).collect()} == {("empty_segment", "ch01", "2"), ("empty_script", "ch02", None)}


def test_small_functions(spark):
    df = spark.createDataFrame([("Dit is één. Dit is twee! En drie", [["Stof", None], ["zand", "3"], [None, None], ["klei", ""]], "abc, " + "dit is een lang fragment van 12 woorden," * 7)], "t string, rows array<array<string>>, answer string")
    r = df.select(
        E.sentence_window(F.col("t"), F.lit(14), F.lit(16)).alias("w"), E.table_text(F.col("rows"), F.lit("Tabel 1.")).alias("table"), E.looping(F.col("answer")).alias("loop"), E.looping(F.col("t")).alias("calm"), E.token_estimate(F.lit("x" * 32)).alias("n"), E.tail_of(F.col("t"), 4).alias("tail"), E.slug(F.lit("  Éva & Co!")).alias("slug"),
        M.spoken_words(F.lit("Één café, eh, twee! o.a. dit"), [("o.a.", "onder andere")]).alias("words"), M.spoken_words(F.lit("1 cafe 2 onder andere dit"), [("o.a.", "onder andere")]).alias("same"),
    ).first()
    assert df.first()["t"][r["w"]["start"] : r["w"]["end"]].strip() == "Dit is twee!"
    assert r["table"] == "[Tabel 1. Kolommen: Stof, kolom 2. Rij 1: Stof zand, kolom 2 3. Rij 2: Stof klei. ]"
    assert (r["loop"], r["calm"], r["n"], r["tail"], r["slug"]) == (True, False, 11, "drie", "eva_co") and r["words"] == r["same"]


def test_people(spark):
    cast = spark.createDataFrame([("wende", "Wende", "host", []), ("g1", "Gast", "guest", ["water", "getijden"]), ("g2", "Ander", "guest", [])], "id string, name string, kind string, domains array<string>")
    asked = spark.createDataFrame([("waterbeheer",), ("getijden",), ("muziek",), (None,)], "domain string")
    assert {r["domain"]: r["guest"] for r in E.picked_guests(asked, cast).collect()} == {"waterbeheer": "g1", "getijden": "g1", "muziek": "g2", None: "g2"}
    raws = spark.createDataFrame([("WENDE",), ("Wendee",), ("gast ",), ("wie?",), (None,)], "raw string")
    assert {r["raw"]: r["speaker"] for r in E.resolved_speakers(raws, cast).collect()} == {"WENDE": "wende", "Wendee": "wende", "gast ": "g1", "wie?": "g1", None: "g1"}
    assert E.assign_misconceptions(["zand is klei", "water is nat"], [["klei is geen zand"], ["niets"], ["water is altijd nat"]]) == [(0, 0, pytest.approx(E.token_set_ratio("zand is klei", "klei is geen zand"))), (1, 2, 100.0)]


def test_complete_audit_in_steps(spark, folder):
    """The findings of every rule by itself, each once; lines are partitioned once and no shuffle is left of a step that is done."""

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in held.split("\n") if "/shuffle_" in f}

    before = files()
    got = Q._complete(spark, folder)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.5)
    assert not files() - before
    got = [tuple(r) for r in got.collect()]
    lines, claims, speakers, lexicon, sections = Q._lines(spark, folder), Q._claims(spark, folder), *(table(spark, folder, x) for x in ("speakers", "lexicon", "sections"))
    alone = S.full_audit(lines, claims.withColumnRenamed("relevance", "exam_relevance"), speakers, Q._definitions(spark, folder).withColumnRenamed("chapter_id", "episode_id"))
    alone = alone.unionByName(W.near_duplicate_lines(lines)).unionByName(K.source_copy(lines, claims)).unionByName(S.overlap_over_terms(lines, lexicon))
    want = {tuple(r) for r in alone.collect()}
    want |= {(*r[:3], "term_before_intro", "warning", r["line_id"], r["term"]) for r in N.early_terms(lines, claims, speakers).collect()}
    want |= {(*r[:3], "unknown_word", "warning", r["line_id"], r["word"]) for r in N.unknown_words_by_episode(lines, A.vocabulary(sections, claims, lexicon)).collect()}
    assert len(got) == len(set(got)) > 100 and set(got) == want
