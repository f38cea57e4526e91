"""Operators for training data on literal cases and against plain-Python versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import containers, leaks, lines, looks, mixing, pieces, pii, queries, scans, scripts, sentences, terms

SECTION = "book_id string, chapter_id string, section_id string, text string, page_lo int, page_hi int, title string, word string"


def sections(spark, texts, lo=None):
    return spark.createDataFrame([("b", "ch01", f"s{i}", t, lo, lo, "t", "x") for i, t in enumerate(texts)], SECTION)


def books(spark, title="Inleiding dijkleer"):
    return spark.createDataFrame([("b", title, "x")], "book_id string, title string, text string")


@pytest.fixture()
def tables(spark, tmp_path):
    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


# Problem 1

WORDS = "Het grote waterverband verandert de bodemwaarde bij laag water en daarna verdwijnt het geheel."


def test_scanned_noise(spark, tables):
    scanned = "Het grote waterverband verandert de bodem-\nwaarde bij laag w@ter en\n\n- 12 -\nlNLElDING DIJKLEER\ndaarna verdwijnt het geheel van noord-\nzuid en weer te-\nrug.\n\n[tabel]\n1 | 2\n33\n"
    clean = [f"{WORDS} Van noord-zuid en weer terug." for _ in range(6)]
    folder = tables(sections=sections(spark, [scanned, scanned, None, "", *clean], 12).union(sections(spark, [scanned], 12)), books=books(spark))
    got = {(r["section_id"], r["line_no"], r["noise"]) for r in scans.p1_found(spark, folder).collect()}
    want = {(0, "hyphen"), (1, "ocr"), (3, "page_number"), (4, "header"), (6, "hyphen")}
    assert {(n, k) for s, n, k in got if s == "s0"} == want
    assert {s for s, _, _ in got} == {"s0", "s1"}
    fixed = {r["section_id"]: r["repaired"] for r in scans.p1_repaired(spark, folder).collect()}
    assert fixed["s0"].startswith("Het grote waterverband verandert de bodemwaarde bij laag water en daarna verdwijnt het geheel van noord-zuid en weer terug.")
    assert "1 | 2\n33" in fixed["s0"] and fixed["s4"] == clean[0]


def test_lines():
    key = lines.headers_of("Inleiding Dijkleer")
    rows = ["43   ch04", "I N L E I D I N G   D I J K L E E R", "blz. 7 van 90", "[l43]", "xxi", "2005.", "Tekst.", "", "[tabel]", "1 | 2", "12"]
    assert lines.classify(rows, list(map(lines.fold, rows)), key) == ["header", "header", "page_number", "page_number", "page_number", "body", "body", "blank", "table", "table", "table"]


# Problem 2


def test_pieces_hold_everything():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["woord ", "zin. ", "\n\n", "x" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 60)))
        limit, overlap = rng.randint(5, 60), rng.randint(0, 4)
        parts = pieces.cut_points(text, [i for i, c in enumerate(text, 1) if c == "."], limit, overlap)
        assert parts[0][0] == 0 and parts[-1][1] == len(text)
        assert all(0 <= b - a <= limit for a, b, _ in parts)
        assert all(q[0] == p[1] - overlap for p, q in itertools.pairwise(parts))
    with pytest.raises(ValueError):
        pieces.cut_points("abc", [], 2, 2)


def test_cut_levels():
    assert pieces.cut_level("a" * 5 + "\n\n" + "b" * 5, [], 6) == "paragraph"
    assert pieces.cut_level("aaa. bbb.", [4, 9], 5) == "sentence"
    assert pieces.cut_level("aaa bbb ccc", [11], 5) == "word"
    assert pieces.cut_level("a" * 20, [20], 5) == "none"


def test_pieces_of_tables(spark, tables):
    limits = spark.createDataFrame([("sections.text", 40, 5)], "item string, max_chars int, overlap_chars int")
    long = "Dit is een zin van een paar woorden. " * 4
    folder = tables(sections=sections(spark, [long, long, None, "", "kort"]).union(sections(spark, [long])), books=books(spark), part_limits=limits)
    rows = pieces.p2_pieces(spark, folder).collect()
    assert {r["section_id"] for r in rows} == {"s0", "s1", "s3", "s4"}
    mine = sorted((r["piece_no"], r["start_pos"], r["end_pos"], r["piece"]) for r in rows if r["section_id"] == "s0")
    assert "".join(p[(5 if i else 0):] for i, (_, _, _, p) in enumerate(mine)) == long
    assert {(r["section_id"], r["cut_level"]) for r in pieces.p2_found(spark, folder).collect()} == {("s0", "sentence"), ("s1", "sentence")}


# Problem 3


def test_plan_fills_containers():
    rng = random.Random(2)
    for _ in range(80):
        capacity = rng.randint(1, 60)
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 12))}
        used, ranks = {}, {s: set() for s in counts}
        for size, rank, n, first in containers.plan(counts, capacity):
            for k in range(n):
                used[first + k] = used.get(first + k, 0) + size
                assert rank + k not in ranks[size]
                ranks[size].add(rank + k)
        assert all(v <= capacity for v in used.values())
        assert all(ranks[s] == set(range(n)) for s, n in counts.items())
        total = sum(s * n for s, n in counts.items())
        assert len(used) <= 1.7 * -(-total // capacity) + 1


def test_pack(spark):
    rows = [("b", f"i{k}", k % 11, "x") for k in range(60)] + [("b", "big", 25, "x"), ("b", "big", 25, "x"), ("b", "null", None, "x"), ("b", "even", 20, "x")]
    got = containers.pack(spark.createDataFrame(rows, "book_id string, item string, size int, rank string"), ["book_id", "item"], 10).collect()
    room = {}
    for r in got:
        if r["container"] != "c0":
            room[r["container"]] = room.get(r["container"], 0) + r["chars"]
    assert max(room.values()) <= 10
    assert sorted(r["item"] for r in got if r["piece_no"] == 0) == sorted({r[1] for r in rows})
    assert sum(r["chars"] for r in got if r["item"] == "big") == 25 and {r["pieces"] for r in got if r["item"] == "even"} == {2}
    assert containers.pack(spark.createDataFrame([], "item string, size int"), ["item"], 10).count() == 0


# Problem 4


def test_terms(spark, tables):
    lexicon = spark.createDataFrame([("b1", " Straße "), ("b2", "STRASSE"), ("b2", "STRASSE"), ("b3", "x"), ("b3", None)], "book_id string, surface string").withColumn("term", F.lit("clash"))
    folder = tables(sections=sections(spark, ["Dijk dijk ab", "dijk", None, ""]).union(sections(spark, ["dijk"]).where("false")), lexicon=lexicon)
    rows = {(r["field"], r["term"]): r for r in terms.p4_terms(spark, folder).collect()}
    assert (rows["sections.text", "dijk"]["occurrences"], rows["sections.text", "dijk"]["records"], rows["sections.text", "dijk"]["mark"]) == (3, 2, "common")
    assert (rows["lexicon.surface", "strasse"]["records"], rows["lexicon.surface", "strasse"]["mark"]) == (2, "common")
    assert rows["lexicon.surface", "x"]["mark"] == "rare" and ("sections.text", "ab") not in rows


# Problem 5


@pytest.mark.parametrize("text, kinds", [("ｄｅ ﬁets", ["compat"]), ("réel", ["combining"]), ("wa​ter", ["invisible"]), ("a b", ["space"]), ("wаter", ["lookalike"]), ("Neem α = 5 m², «мост», 你好！", []), ("", []), ("हिंदी ความ", [])])
def test_disguises(text, kinds):
    assert looks.disguise_kinds(text) == kinds


def test_one_form_is_stable_and_equal():
    plain = "De fiets rijdt één keer door het water."
    for disguised in ("De ﬁets rijdt één keer door het wаter.", "De fi­ets rijdt één keer door het ｗater."):
        assert scripts.one_form(disguised) == plain == scripts.one_form(scripts.one_form(disguised))
        assert scripts.skeleton(disguised) == scripts.skeleton(plain)


def test_looks_of_tables(spark, tables):
    claims = spark.createDataFrame([("b", "c", "c1", ("wаter",), "x"), ("b", "c", "c1", ("wаter",), "x"), ("b", "c", "c2", (None,), "x"), ("b", "c", "c3", ("water",), "x")], "book_id string, chapter_id string, claim_id string, span struct<quote: string>, text string")
    folder = tables(sections=sections(spark, ["gewoon", None]), claims=claims)
    assert [(r["record_id"], r["disguise"]) for r in looks.p5_found(spark, folder).collect()] == [("c1", "lookalike")]
    assert {r["unified"] for r in looks.p5_unified(spark, folder).where("record_id like 'c%'").collect()} == {"water", None}
    assert {(r["form"], r["uses"]) for r in looks.p5_groups(spark, folder).collect()} == {("wаter", 2), ("water", 1)}


def test_section_texts_are_grouped_by_looks(spark, tables):
    claims = spark.createDataFrame([("b", "c", "c1", ("water",))], "book_id string, chapter_id string, claim_id string, span struct<quote: string>")
    folder = tables(sections=sections(spark, ["De dijk.", "De d\u0456jk.", "wat\u0435r", "anders", None]), claims=claims)
    groups = {}
    for r in looks.p5_groups(spark, folder).collect():
        groups.setdefault(r["look"], set()).add(r["form"])
    assert sorted(map(sorted, groups.values())) == [["De dijk.", "De d\u0456jk."], ["water", "wat\u0435r"]]


# Problem 6

SENTENCES = [
    "Dit geldt o.a. voor de dijk.", "De les van mevr. A. B. Jansen begint ca. 4.30 uur.", "“Waarom daalt het water?” vroeg de docent.", "Het gaat om de dijk, het water enz.", "Daarna komt de bodem.", "Wat een dijk betekent?!", "Niets, zolang het water stijgt.", "Zie blz. 12 voor de bodem.", "In 1990 brak de dijk.",
]


def ends(spark, texts):
    df = sections(spark, texts)
    out = {}
    for r in sentences.sentence_ends(df, books(spark)).collect():
        out.setdefault(r["section_id"], []).append(r["end_pos"])
    return {k: sorted(v) for k, v in out.items()}


def test_sentences(spark):
    filler = ["De dijk houdt het water. Daarna komt het water bij de bodem. De les is goed, daarna niet. Het water stijgt.", "Elk uur zijn de bodem en de dijk anders dan het water, en de dijk brak niet. Niets stijgt."] * 8
    text = " ".join(SENTENCES)
    want, at = [], 0
    for s in SENTENCES:
        at = text.index(s, at) + len(s)
        want.append(at)
    got = ends(spark, [text, "土壤变化。“盐分没有变吗？”老师问道。", "ดินเปลี่ยน เกลือลดลง", "Kop zonder punt\n\nEen zin die\n\n- 3 -\nInleiding dijkleer\n\ndoorgaat. Klaar.", "[tabel]\n1 | 2\n3. 4", "", None, *filler])
    assert got["s0"] == want
    assert got["s1"] == [5, 19]
    assert len(got["s2"]) == 2 and len(got["s3"]) == 3 and len(got["s4"]) == 1 and "s5" not in got and "s6" not in got


def test_forward_backward_equals_enumeration():
    rng = random.Random(4)
    for _ in range(40):
        rows = [{"end_pos": i, "words": rng.randint(1, 3), "odds": rng.uniform(-4, 4)} for i in range(rng.randint(1, 6))]
        total, marginal = 0.0, [0.0] * len(rows)
        for states in itertools.product((0, 1), repeat=len(rows)):
            score = sum(r["odds"] for r, s in zip(rows, states) if s) + sum(sentences.ONE_WORD for i in range(1, len(rows)) if states[i] and states[i - 1] and rows[i]["words"] <= 1)
            total += np.exp(score)
            for i, s in enumerate(states):
                marginal[i] += s * np.exp(score)
        assert sentences.decide(rows) == [i for i, m in enumerate(marginal) if m / total > 0.5]


# Problem 7


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([11, 30, 45])))) for i in range(12)]
    docs = []
    for n in range(80):
        own = rng.choice(items)[1].split()
        kind = n % 5
        if kind == 0:
            part = own
        elif kind == 1:
            part = own[:]
            for k in rng.sample(range(len(own)), 4):
                part[k] = word() + "q"
        elif kind == 2:
            part = own[3:15]
        elif kind == 3:
            part = own[2:13] if len(own) > 13 else own[2:9]
        else:
            part = []
        docs.append((n, "  ".join([word() + "z" for _ in range(9)] + [w.upper() + "," for w in part] + [word() + "z" for _ in range(9)]), "x"))
    docs += [(100, None, "x"), (101, "", "x")]

    def holds(text, item):
        a, b = leaks.words_of(text), leaks.words_of(item)
        runs = {tuple(a[i : i + 12]) for i in range(len(a) - 11)}
        if any(tuple(b[i : i + 12]) in runs for i in range(len(b) - 11)):
            return True
        return any(sum(x != y for x, y in zip(a[i : i + len(b)], b)) <= 4 for i in range(len(a) - len(b) + 1))

    want = {(d, i) for d, t, _ in docs if t for i, x in items if holds(t, x)}
    frame = spark.createDataFrame(docs + docs[:1], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(frame, spark.createDataFrame([*items, (99, None)], "item_id long, text string")).collect()}
    assert got == want and len(want) >= 45
    assert leaks.find_leaks(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_a_later_run_of_the_same_alignment_is_a_leak():
    own = [f"{'abcdefghij'[k // 10]}{'klmnopqrst'[k % 10]}woord" for k in range(43)]
    text = lambda words, same: " ".join(w if any(a <= k < b for a, b in same) else f"anders{k}" for k, w in enumerate(words))
    held = lambda item, shown: leaks.settled(leaks.Items([(1, item)]).finds(leaks.normal(shown)))
    assert held(" ".join(own), text(own, [(0, 9), (11, 18), (25, 37)])) == [1]
    assert held(" ".join(own), text(own, [(0, 11), (12, 23), (24, 35)])) == []
    short = [w[:2] if k < 18 else w for k, w in enumerate(own)]  # its first blocks are searched after the others
    assert held(" ".join(short), text(short, [(0, 12), (24, 33)])) == [1]


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    frame = ["wat", "is", "de", "rol", "van", "het"]
    items = [(i, " ".join([*frame, *(f"{a}{i}x" for a in "pqrstu")])) for i in range(60)]
    docs = []
    for i, text in items:
        words = text.split()
        for k in rng.sample(range(12), 4):
            words[k] = f"anders{k}"
        docs.append((i, " ".join(["voor", "af", *words, "en", "na"])))
    frame_of_docs = spark.createDataFrame(docs, "doc_id long, text string")
    frame_of_items = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for block, chars in ((2000, 10**9), (20, 10**9), (2, 10**9), (20, 1500)):
        monkeypatch.setattr(leaks, "ITEM_BLOCK", block)
        monkeypatch.setattr(leaks, "SHIPPED_CHARS", chars)
        got.append({tuple(r) for r in leaks.find_leaks(frame_of_docs, frame_of_items).collect()})
    assert got[0] == got[1] == got[2] == got[3] and {(i, i) for i, _ in items} <= got[0]


# Problem 8


def test_water_filling():
    take = mixing.water_fill([("a", 0.5, 1, 100), ("b", 0.3, 4, 10), ("c", 0.2, 1, 1000), ("none", 0.1, 3, 0)], 400)
    assert take == {"a": 100.0, "b": 40.0, "c": 260.0, "none": 0.0}
    even = [("a", 0.5, 2, 100), ("b", 0.5, 1, 50)]
    assert mixing.water_fill(even, mixing.balanced_total(even)) == {"a": 50.0, "b": 50.0}
    assert mixing.water_fill([], 10) == {} and mixing.balanced_total([]) == 0


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, "a" if i % 3 else "b", "woord " * rng.randint(1, 30)) for i in range(300)] + [(900, None, "x"), (901, "a", None), (902, "other", "x"), (0, "b", "woord")]
    targets = spark.createDataFrame([("m", "a", 0.4, 1), ("m", "b", 0.6, 3), ("m", "c", 0.2, 2)], "mix_name string, source string, weight double, max_repeats int")
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    uses, shares = mixing.mix(frame, targets)
    rows = {r["source"]: r for r in shares.collect()}
    assert abs(rows["a"]["reached_share"] - 0.4) < 0.02 and abs(rows["b"]["reached_share"] - 0.6) < 0.02 and rows["c"]["tokens"] == 0
    used = uses.collect()
    assert max(r["repeats"] for r in used if r["source"] == "a") == 1 and max(r["repeats"] for r in used) <= 3
    assert not {900, 901, 902} & {r["doc_id"] for r in used} and len({r["doc_id"] for r in used}) == len(used)
    again = {(r["doc_id"], r["repeats"]) for r in mixing.mix(frame.repartition(5), targets)[0].collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in used}


def test_a_small_source_does_not_shrink_the_whole_mix(spark, tables):
    docs = [(i, "big", "woord " * 20) for i in range(50)] + [(100, "tiny", "woord " * 20)]
    folder = tables(documents=spark.createDataFrame(docs, "doc_id long, source string, text string"), mix_targets=spark.createDataFrame([("m", "big", 0.8, 1), ("m", "tiny", 0.2, 1)], "mix_name string, source string, weight double, max_repeats int"))
    rows = queries.QUERIES["p8_mix_all"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {d[0] for d in docs} and {r["repeats"] for r in rows} == {1}
    assert queries.QUERIES["p8_mix"](spark, folder).count() < 10


# Problem 9

PII = [
    ("Mijn naam is {Sjors de Vries} en bel {06-12345678} of mail {s.vries@example.org}.", ["name", "phone", "email"]),
    ("Bezorgadres: {Dijkstraat 12 bis}, 1234 AB Turfstad. Burgerservicenummer: {999912345}.", ["address", "id_number"]),
    ("Kind regards,\n{MARY VAN DYKE}\n{12 Peat Lane}\n{(212) 555-0116}", ["name", "address", "phone"]),
    ("Vraag het aan mevr. {T. Wiekel}; het bestelnummer is 483920177, ISBN 978-0-00-148211-0, zaal 2.", ["name"]),
    ("Mijn naam is {J. B. Bakker} en ik heb een vraag.", ["name"]),
    ("Volgens mevr. {Anna de Boer} klopt het niet.", ["name"]),
    ("contact: {E. van der Meer}, {06 12 34 56 78}.", ["name", "phone"]),
    ("mail: {jan [at] school [dot] example}", ["email"]),
    ("De les duurt van 12.30-13.45 uur. De Dijkstraat is smal. Stichting Dijkzicht betaalt 2 x 1.250,00 euro.", []),
]


def test_pii(spark):
    docs, want, k = [], set(), 0
    for _ in range(12):
        for text, kinds in PII:
            plain, spans = "", []
            for i, part in enumerate(text.replace("}", "{").split("{")):
                if i % 2:
                    spans.append(len(plain))
                plain += part
            docs.append((k, plain, "x"))
            want |= {(k, s, t) for s, t in zip(spans, kinds)}
            k += 1
    docs += [(900, None, "x"), (901, "", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, votes string")
    assert {(r["doc_id"], r["start_pos"], r["pii_type"]) for r in pii.find_pii(frame).collect()} == want
    masked = {r["doc_id"]: r["masked"] for r in pii.masked(frame).collect()}
    assert masked[0] == "Mijn naam is <NAME> en bel <PHONE> of mail <EMAIL>." and masked[8] == PII[8][0] and masked[900] is None and masked[901] == ""


@pytest.mark.parametrize("text", ["jan at voorbeeld punkt de", "jan at example.org", "jan at example [dot] org", "jan at example point fr", "jan (ät) example.org", "jan apestaart example punto es", "jan@example.org"])
def test_an_address_is_proposed_in_every_form(text):
    assert [(c[0], c[1], c[2]) for c in pii.candidates(f"mail: {text}") if c[0] == "email"] == [("email", 6, 6 + len(text))]


def test_label_model_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < 0.5, 0, np.where(rng.random(4000) < 0.9, truth, ~truth) * 2 - 1) for _ in range(4)] + [np.where(truth, rng.random(4000) < 0.7, 0)], axis=1).astype(int)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = pii.label_model(patterns, counts.astype(float), 0.4)[where.ravel()]
    assert ((posterior > 0.5) == truth).mean() > 0.88


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_methods_are_in_the_plans(spark, folder):
    terms_plan = plan_of(terms.p4_found(spark, folder))
    assert "MapInArrow" in terms_plan and "rangepartitioning" in terms_plan and "Sort [term" in terms_plan
    assert "container" in plan_of(containers.p3_found(spark, folder)) and "ArrowEvalPython" in plan_of(containers.p3_found(spark, folder))
    assert "SortMergeJoin" in plan_of(scans.p1_repaired(spark, folder))


def test_skeleton_keeps_superscripts_and_knows_styles():
    assert scripts.skeleton("5 m\u00b2") == "5 m\u00b2" and scripts.skeleton("\U0001d427\u0456et") == "niet"
    assert looks.disguise_kinds("\U0001d427iet m\u00b2") == []


def test_runs_go_on_over_batches():
    import pyarrow as pa

    rng = random.Random(9)
    rows = sorted((t, f, r, rng.randint(1, 5)) for t in "abcd" for f in "xy" for r in "123456789" for _ in range(rng.choice([0, 1, 1, 2])))
    want = {}
    for t, f, r, n in rows:
        want.setdefault((f, t), {}).setdefault(r, []).append(n)
    want = {k: (sum(max(x) for x in v.values()), len(v)) for k, v in want.items()}
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in ([x[1] for x in part], [x[0] for x in part], [x[2] for x in part], [x[3] for x in part])], names=["field", "term", "record", "n"]) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = [tuple(r.values()) for b in terms._scan_runs(iter(batches)) for r in b.to_pylist()]
        assert {(f, t): (o, r) for f, t, o, r in got} == want and len(got) == len(want)
    assert list(terms._scan_runs(iter([]))) == []


def test_pieces_are_at_least_half_full():
    head, tail = "Kop. " * 50 + "\n\n", "Een zin van dit lange stuk tekst zonder witregels. " * 400
    parts = pieces.cut_points(head + tail, [i + 1 for i, c in enumerate(head + tail) if c == "."], 8000, 200)
    assert all(b - a > 4000 for a, b, _ in parts[:-1])


def test_long_unbroken_texts_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        sentences.parse("风速的实验会突然下降。老师说什么。" * n, "t", sentences.Counter())
        return time.process_time() - began

    took(100)
    assert took(8000) < 40 * max(took(800), 0.01)


def test_all_queries_run(spark, folder):
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() >= 0, name
