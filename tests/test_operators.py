"""Operators on literal cases: nulls, empty and repeated rows, ties, order, and plain-Python versions of the folds."""

import hashlib
import json
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import external as E
from lectern.operators import folds as W
from lectern.operators import fuzzy as Z
from lectern.operators import lexicon as L
from lectern.operators import matching as M
from lectern.operators import planning as P
from lectern.operators import script as S
from lectern.operators import signal as G
from lectern.operators import structure as D
from lectern.operators import telemetry as T
from lectern.operators import transcript as N
from lectern.plans.text_queries import QUERIES as Q
from lectern.sources import files
from lectern.streaming import events as V

LINE = "book_id string, episode_id string, revision int, seg_no int, seg_type string, line_no int, pos int, line_id string, speaker string, text string, tags array<string>, covers array<string>, overlap struct<mode: string, target: string, cut_word: string>, pause_after_ms int, target_minutes int, delivery string, mood string, timing string, reaction string, phrases array<struct<text: string, delivery: string, pause_after: string>>, extra string"


def raw(rows, spark):
    """rows of (seg_no, seg_type, line_no, pos, speaker, text, tags, covers, overlap, pause)."""
    full = [("b", "ch01", 1, s, st, n, p, f"l{p:03d}", who, t, tags, cov, ov, pause, 10, None, None, None, None, None, "x") for s, st, n, p, who, t, tags, cov, ov, pause in rows]
    return spark.createDataFrame(full, LINE)


SCRIPT = [
    (1, "cold_open", 1, 1, " Wende ", "Een lange regel die precies zo nog eens terugkomt in deze aflevering.", ["laughs"], ["c1"], None, 0),
    (1, "cold_open", 2, 2, "tjalk", "Wacht even, dat begrijp ik nog niet helemaal", [], ["c9"], ("interrupt", "l001", "aflevering"), 0),
    (2, "body", 1, 3, "tjalk", "Een lange regel die precies zo nog eens terugkomt in deze aflevering!", [], ["c1"], ("backchannel", "l001", None), 300),
    (2, "body", 2, 4, "onbekend", None, None, None, None, None),
    (3, "outro", 1, 5, "wende", "Hm?", [], [], None, 0),
]
CAST = "id string, name string, kind string, role string, domains array<string>, tic_markers array<string>, exaggeration double, cfg_weight double, temperature double, speech_rate double"


@pytest.fixture(scope="module")
def cast(spark):
    return spark.createDataFrame([("wende", "Wende", "host", "explainer", [], ["kijk"], 0.5, None, None, None), ("tjalk", "Tjalk", "host", "skeptic", [], ["wacht even"], 0.7, None, None, None)], CAST)


def found(df):
    return {(r["rule"], r["line_id"]) for r in df.collect()}


def test_script_rules(spark, cast):
    lines = S.script_lines(raw(SCRIPT + SCRIPT[:1], spark))
    assert lines.count() == 5
    assert found(S.duplicate_lines(lines)) == {("duplicate_line", "l003")}
    assert ("unknown_speaker", "l004") in found(S.cast_rules(lines, cast))
    got = found(S.overlap_rules(lines))
    assert ("interrupt_without_fragment", "l001") in got and ("overlap_at_segment_start", "l003") in got
    claims = spark.createDataFrame([("b", "ch01", "c1", 4), ("b", "ch01", "c2", 5), ("b", "ch01", "c3", 1)], "book_id string, chapter_id string, claim_id string, exam_relevance int")
    got = {(r["rule"], r["claim_id"]) for r in S.coverage_rules(lines, claims).collect()}
    assert got == {("missing_claim", "c2"), ("unknown_claim", "c9")}
    assert found(S.audit(lines, claims, cast)) >= {("duplicate_line", "l003"), ("unknown_speaker", "l004")}


def test_listed_phrases_patterns_and_recitals(spark, cast):
    texts = ["Dat is een  Game Changer, en tot de volgende keer.", "OKÉ, kortom: het water stijgt.", "Het is niet alleen het water, maar ook de bodem.", "Dijken, dammen en sluizen.", "Nou, Kwel: water dat onder de dijk door komt.", "Kwelder en zo: niets.", None]
    lines = S.script_lines(raw([(1, "body", k, k, "wende", t, [], [], None, 0) for k, t in enumerate(texts, 1)], spark))
    assert {(r["line_id"], r["claim_id"]) for r in S.phrase_rule(lines).collect()} == {("l001", "game changer"), ("l001", "tot de volgende keer"), ("l002", "kortom")}
    assert len(set(S.BANNED_PHRASES)) == 52
    got = {(r["rule"], r["severity"], r["line_id"]) for r in S.pattern_rules(lines).collect()}
    assert got == {("summary_opener", "blocking", "l002"), ("not_x_but_y", "warning", "l003"), ("three_part_flourish", "warning", "l004")}
    terms = spark.createDataFrame([("b", "ch01", " kwel "), ("b", "ch02", "kwelder en zo"), ("b", "ch01", None)], "book_id string, episode_id string, term string")
    assert found(S.definition_recital(lines, terms)) == {("definition_recital", "l005")}
    claims = spark.createDataFrame([], "book_id string, chapter_id string, claim_id string, exam_relevance int")
    assert found(S.full_audit(lines, claims, cast, terms)) >= {(r, i) for r, _, i in got} | {("definition_recital", "l005"), ("banned_phrase", "l001")}


def test_rules_on_an_empty_script(spark, cast):
    lines = S.script_lines(raw([], spark))
    claims = spark.createDataFrame([], "book_id string, chapter_id string, claim_id string, exam_relevance int")
    assert S.audit(lines, claims, cast).count() == 0
    assert S.turns(lines).count() == 0
    assert M.near_duplicates(lines).count() == 0


def test_turns_and_renumbering(spark):
    lines = S.script_lines(raw(SCRIPT, spark))
    assert [r["lines"] for r in S.turns(lines).orderBy("turn_no").collect()] == [1, 1, 1, 1, 1]
    new = {r["line_id"]: (r["new_id"], r["new_target"]) for r in S.renumbered(lines.where("line_id <> 'l001'")).collect()}
    assert new["l002"] == ("l001", None) and new["l005"][0] == "l004"


def test_claims(spark):
    span = ("s1", 0, 0, "Het Woord", None)
    rows = [("b", "c", f"c{i}", i, "x", None, d, 5, span) for i, d in enumerate([3, 9, 5, 1, 5, 2], 1)]
    claims = P.claims_once(spark.createDataFrame(rows + rows[:2], "book_id string, chapter_id string, claim_id string, claim_no int, claim string, context string, difficulty int, exam_relevance int, span struct<section: string, start: int, end: int, quote: string, match_score: double>"))
    assert P.hardest_claims(claims).first()["hardest"] == "c2"
    assert [r["claim_id"] for r in P.guest_claims(claims).orderBy("place").collect()] == ["c2", "c3"]
    assert [r["block_no"] for r in P.equal_blocks(claims).orderBy("claim_id").collect()] == [1, 1, 2, 2, 3, 3]
    sections = spark.createDataFrame([("b", "c", "s1", 1, "niets"), ("b", "c", "s2", 2, "dan het woord hier"), ("b", "c", "s3", 3, None)], "book_id string, chapter_id string, section_id string, section_no int, text string")
    got = P.located_quotes(claims, sections).where("claim_id = 'c1'").collect()
    assert [(r["section_id"], r["start_pos"], r["end_pos"], r["score"]) for r in got] == [("s2", 4, 13, 99)]


def test_edit_distances():
    assert M.error_rate(["a", "b", "c"], ["a", "c"]) == pytest.approx(1 / 3)
    assert (M.error_rate([], ["x"]), M.error_rate([], [])) == (1.0, 0.0)
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        want = 100.0 if not a and not b else 200 * table[-1][-1] / (len(a) + len(b))
        assert M.indel_ratio(a, b) == pytest.approx(want)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randint(0, 3)) for _ in range(14)) for _ in range(12)]
    texts = base + [t + " eind" for t in base] + [base[0]] * 3 + ["kort", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = sorted({t for t in texts if t})
    sets = {k: {tuple(k.split()[i : i + 5]) for i in range(len(k.split()) - 4)} for k in keys}
    want = {k: sum(1 for o in keys if o != k and sets[k] and sets[o] and len(sets[k] & sets[o]) >= 0.8 * len(sets[k] | sets[o])) for k in keys}
    got = {r["key"]: r["links"] for r in M.near_duplicates(df).collect()}
    assert got == want and sum(want.values()) > 0


def test_near_duplicate_digests_shuffle_no_text(spark, monkeypatch):
    """Whatever the counters hold, and with repeated rows, copies and families, the links are those of brute force; texts stay where they are read."""
    rng = random.Random(11)
    base = [" ".join(rng.choice("ab cd ef gh ij".split()) + str(rng.randint(0, 5)) for _ in range(rng.randint(4, 40))) for _ in range(60)]
    texts = base + [t + " eind" for t in base] + [t + " eind nu" for t in base[:20]] + base[:9] + ["kort", "", None, base[0].upper() + "!"]
    rows = [("b", "e", 1, f"l{k}", t) for k, t in enumerate(texts)]
    raw_ = spark.createDataFrame(rows + rows[:30], "book_id string, episode_id string, revision int, line_id string, text string")
    flat = [t.lower().rstrip("!") for t in texts if t]
    sets = {k: {tuple(k.split()[i : i + 5]) for i in range(len(k.split()) - 4)} for k in flat}
    links = {k: sum(1 for o in sets if o != k and sets[k] and sets[o] and len(sets[k] & sets[o]) >= 0.8 * len(sets[k] | sets[o])) for k in sets}
    want = {hashlib.md5(k.encode()).hexdigest(): (flat.count(k), links[k]) for k in sets}
    for bits in (6, 16):
        monkeypatch.setattr(M, "RARITY_BITS", bits)
        monkeypatch.setattr(M, "SHARED_BITS", bits + 3)
        df = M.near_duplicate_digests(raw_, [*S.EPISODE, "line_id"])
        assert {r["key"]: (r["copies"], r["links"]) for r in df.collect()} == want
    assert max(n for _, n in want.values()) > 1
    plan = Q["script_near_duplicates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    sent = [x for x in plan.splitlines() if "Aggregate [" in x or "Join " in x or "RepartitionBy" in x]
    assert sent and not any("text#" in x or "key#" in x for x in sent)


def test_takes(spark):
    takes = spark.createDataFrame([(1, 1, 0.0, 9.0, 10.0), (1, 2, None, 10.5, 10.0), (1, 3, 0.4, 10.0, 10.0), (2, 1, 0.5, 1.0, 1.0), (2, 2, 0.2, 9.0, 1.0)], "turn int, take int, wer double, duration double, target double")
    assert [(r["turn"], r["take"], r["flagged"]) for r in M.chosen_takes(takes).orderBy("turn").collect()] == [(1, 2, False), (2, 2, True)]


def test_lexicon(spark):
    raw_ = spark.createDataFrame([("b", " A ", "k", "b", True, None, "ch01"), ("b", "a", "k", "z", False, None, None), ("b", "b", "k", "c", None, None, "ch02"), ("b", "b", "k", "c", None, None, "ch02"), ("b", None, "k", "q", None, None, None)], "book_id string, surface string, kind string, spoken string, lock boolean, note string, source_chapter string")
    merged = L.merged(raw_)
    assert {(r["key"], r["spoken"], r["locked"]) for r in merged.collect()} == {("a", "b", True), ("b", "c", False)}
    texts = spark.createDataFrame([("b", "a b ab A"), ("b", None), ("other", "a")], "book_id string, text string")
    assert [r["spoken"] for r in L.applied(texts, merged).orderBy("book_id", "text").collect()] == [None, "b c ab B", "a"]


def test_folds(spark, cast):
    lines = S.script_lines(raw(SCRIPT, spark))
    carried = {r["line_id"]: r["exaggeration"] for r in W.emotion_carry(lines, cast).collect()}
    assert carried["l001"] == 0.75 and carried["l002"] == round(0.8 * 0.7 + 0.2 * 0.75, 3)
    placed = {r["turn_no"]: r for r in W.timeline(W.script_turns(lines)).collect()}
    assert placed[1]["start_s"] == 0
    long = [(1, "body", i, i, "wende" if i % 3 else "tjalk", "x" * 400, [], [], None, 0) for i in range(1, 30)]
    blocks = W.script_blocks(S.script_lines(raw(long, spark)), 3000).groupBy("block_no").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in blocks) == 29 and max(r["n"] for r in blocks) <= 7
    a, c = "de dijk houdt het water tegen en dat is al eeuwen lang precies zo gebleven", "de dijk houdt het water tegen en dat is al eeuwen lang precies anders geweest"
    paras = spark.createDataFrame([("b", "s", 0, a), ("b", "s", 1, a), ("b", "s", 2, c), ("b", "s", 3, "kort"), ("b", "s", 4, "kort")], "book_id string, section_id string, para_no int, para string")
    kept = [r["kept"] for r in W.kept_paragraphs(paras).orderBy("para_no").collect()]
    assert kept == [True, False, M.indel_ratio(a, c) < W.REPEAT_RATIO, True, True]


def test_repeats_go_across_the_sections_of_a_chapter(spark):
    a = "de dijk houdt het water tegen en dat is al eeuwen lang precies zo gebleven"
    b = a.replace("eeuwen", "jaren")
    assert M.indel_ratio(a, b) >= W.REPEAT_RATIO
    rows = [("b", "c1", "s9", 1, a), ("b", "c1", "s1", 2, "kort\n\n" + b), ("b", "c2", "s2", 3, a), ("b", None, "s3", 4, a), ("b", None, "s4", 5, a), ("d", "c1", "s1", 2, b)]
    sections = spark.createDataFrame([(*r[:4], "t", r[4]) for r in rows], "book_id string, chapter_id string, section_id string, section_no int, title string, text string")
    got = {(r["book_id"], r["section_id"], r["para_no"]): r["kept"] for r in W.kept_paragraphs(D.paragraphs(sections)).collect()}
    assert got == {("b", "s9", 0): True, ("b", "s1", 0): True, ("b", "s1", 1): False, ("b", "s2", 0): True, ("b", "s3", 0): True, ("b", "s4", 0): True, ("d", "s1", 0): True}


def test_no_repeat_is_lost_by_the_filter():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("abcde 𝔸") for _ in range(rng.randint(60, 120)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "a"])
        b = "".join(b)
        passed = len(W._may_repeat(len(b), W._grams(b), np.array([len(a)]), W._grams(a)[None])) == 1
        assert passed or M.indel_ratio(a, b) < W.REPEAT_RATIO or abs(len(a) - len(b)) >= W.REPEAT_LENGTH * len(b)


def test_results_do_not_depend_on_partitions(spark, cast):
    lines = S.script_lines(raw(SCRIPT, spark))
    assert found(S.overlap_rules(lines.repartition(1))) == found(S.overlap_rules(lines.repartition(7)))


def test_structure(spark):
    s = spark.createDataFrame([("b", "c", "s1", 1, "t", "Op 10\n\njuli kwam hij.\n\n____ vul in\n\n* noot\n\nBronnen", "x"), ("b", "c", "s2", 2, "t", None, "x"), ("b", "c", "s3", 3, None, "", "x")], "book_id string, chapter_id string, section_id string, section_no int, title string, text string, line string")
    p = D.paragraphs(s)
    assert [r["para"] for r in D.rejoined(p).orderBy("para_no").collect()][0] == "Op 10 juli kwam hij."
    c = D.cleaned(p).first()
    assert (c["fill_in"], c["footnote"], c["references"], c["kept"]) == (1, 1, 1, 2)
    row = spark.createDataFrame([("a = b + 2", 3725.0, "x –")], "t string, s double, f string").select(X.formula_density(F.col("t")).alias("d"), X.seconds_text(F.col("s")).alias("s"), X.ends_in_fragment(F.col("f")).alias("f")).first()
    assert row["d"] == 0.25 and row["s"] == "1 u 02 min" and row["f"] is False


def test_signal(spark):
    clips = spark.createDataFrame([(1, [1.0] * 8 + [0.0] * 8, 0), (2, [], 0)], "vec_id long, embedding array<float>, label int")
    levels = {r["vec_id"]: r["rms_db"] for r in G.clip_levels(clips).collect()}
    assert levels[1] == pytest.approx(20 * math.log10(math.sqrt(0.5)), abs=1e-3) and levels[2] is None
    assert [(r["first_frame"], r["frames"]) for r in G.pauses(G.frame_levels(clips)).collect()] == [(1, 1)]
    assert clips.where("vec_id = 1").select(G.faded(F.col("embedding"), 2).alias("x")).first()["x"][0] == 0.5


def test_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"run": "r1", "seconds": 2.0, "more": 1}\n{"run": "r2", "sec')
    assert [(r["run"], r["seconds"]) for r in files.read_jsonl(spark, str(tmp_path / "t.jsonl"), files.TIMINGS).collect()] == [("r1", 2.0)]
    (tmp_path / "b.md").write_text("# Titel\n\n## Een\nregel een\nregel twee\n\n- bron\n")
    assert [(r["kind"], r["text"]) for r in files.read_markdown(spark, str(tmp_path / "b.md")).orderBy("unit_no").collect()] == [("title", "Titel"), ("chapter", "Een"), ("para", "regel een regel twee"), ("source", "bron")]
    with wave.open(str(tmp_path / "c.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\xff\x7f\x00\x00" * 4)
    clip = files.read_wav(spark, str(tmp_path)).first()
    assert clip["rate"] == 8000 and clip["samples"] == pytest.approx([0.5] * 4)
    log = spark.createDataFrame([("ch00", 1, "a"), ("ch01", 2, "b"), ("ch02", 3, "c"), ("ch01", 4, "d")], "episode string, ln int, v string")
    assert [(r["episode"], r["v"]) for r in files.last_written(log).collect()] == [("ch00", "a"), ("ch02", "c"), ("ch01", "d")]
    keyed = spark.createDataFrame([("aa1", 1), ("aa1", 1), ("bb2", 2)], "content_key string, v int")
    for _ in range(2):
        files.write_by_key(keyed, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_model_calls(spark):
    requests = spark.createDataFrame([("summary", "Een zin. Nog een."), ("summary", "Een zin. Nog een."), ("lint", "1 2 3 4"), ("lint", None), ("none", "x")], "task string, prompt string")
    answers = E.called(requests)
    rows = answers.collect()
    assert len(rows) == 3 and [r["error"] is not None for r in rows if r["task"] == "none"] == [True]
    assert E.parsed(answers, "summary").first()["value"]["summary"] == "Een zin."
    stored = spark.createDataFrame([(r["request_hash"], r["task"], json.dumps({"hits": ["kept"]}), 1, None) for r in rows if r["task"] == "lint"], answers.schema)
    got = {r["task"]: r["answer"] for r in E.answered(requests, stored).collect()}
    assert "kept" in got["lint"] and got["summary"]


def test_streams_equal_batch(spark, folder, tmp_path):
    batch = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):
        batch.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    query = V.job_states(V.read_events(spark, str(tmp_path / "in"), files=2)).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    query.awaitTermination(120)
    events = T.latest_status(batch).select("user_id", "offset", "events")
    got = spark.table("states").groupBy("user_id").agg(F.max("offset").alias("offset"), F.max("events").alias("events"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.collect()))


def test_best_window_equals_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        needle, text = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, n))) for n in (6, 25))
        got = Z.best_window(needle, text)
        if not needle or not text:
            assert got is None
            continue
        n, m = len(needle), len(text)
        windows = [(0, m)] if n >= m else [(max(0, r - n), min(m, r)) for r in range(1, m + n)]
        best = max(M.indel_ratio(needle, text[a:b]) for a, b in windows)
        assert (got[2] if got else 0.0) == pytest.approx(best)
        if got:
            assert M.indel_ratio(needle, text[got[0] : got[1]]) == pytest.approx(best)
    assert Z.partial_ratio("dijk", "de dijken") == 100.0 and Z.token_set_ratio("a b c", "b a") == 100.0 and Z.token_set_ratio("", "a") == 0.0
    assert Z.window_words("een waterdijk hier", 6, 9) == (4, 13)


def test_fuzzy_quotes(spark):
    claims = spark.createDataFrame([("b", "c", "k1", "s1", "de dijk hoedt het water"), ("b", "c", "k2", "s1", "iets volkomen anders zonder plaats"), ("b", "c", "k3", "s2", "de dijk houdt het water")], "book_id string, chapter_id string, claim_id string, section string, quote string")
    sections = spark.createDataFrame([("b", "c", "s1", 1, "Nu houdt de dijk houdt het water tegen."), ("b", "c", "s2", 2, None)], "book_id string, chapter_id string, section_id string, section_no int, text string")
    located = P.located_quotes(claims, sections)
    assert {r["claim_id"] for r in located.where("score = 100").collect()} == {"k3"}
    got = Z.fuzzy_quotes(located, claims, sections).collect()
    assert [(r["claim_id"], r["section_id"], r["start_pos"]) for r in got] == [("k1", "s1", 9)] and got[0]["score"] > 90


def test_times(spark):
    lines = S.script_lines(raw(SCRIPT, spark))
    times = {r["line_id"]: r for r in N.line_times(lines).collect()}
    assert times["l001"]["start_s"] == 0 and times["l004"]["start_s"] == pytest.approx(times["l003"]["end_s"] + 0.3, abs=2e-3)
    words = N.word_times(lines).where("line_id = 'l002'").orderBy("word_no").collect()
    assert words[0]["word"] == "Wacht" and all(a["end_s"] <= b["start_s"] + 1e-9 for a, b in zip(words, words[1:]))
