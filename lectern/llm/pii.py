"""Problem 9: personal information inside free text.

Method: weak supervision. Broad patterns propose spans; labelers (patterns of shape, gazetteers of given names learned from the
collection itself, words of context) vote for, against or not at all. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is and how likely each pattern is a true span; a logistic span classifier is then trained on
those labels and decides. Both models see all candidates through their pattern counts, whose number does not grow with the data.

Null and empty texts hold nothing; a document repeated under another id is masked there too; of overlapping spans the more
certain, then the longer stays; positions count characters of the stored text; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import bounded_arrow_batches, kept, sized_side
from lectern.sources.tables import table

TYPES = ("name", "email", "phone", "id_number", "address")
#: Votes per span: shape, cue, title, line, initials, particle, near, against; a gazetteer vote is added from the whole collection.
VOTES = 9
#: The first guess of each labeler's rates counts as much as this share of the spans.
PRIOR_SHARE = 0.01
#: Share of a given name's uses that strong evidence must stand with for the gazetteer to list it.
STRONG_SHARE = 0.02

# Particles of surnames, words that announce a kind of span, and words that stand before other numbers.
_PARTS = "van der|van den|van de|van 't|van ’t|van het|van|ten|ter|te|op de|in 't|de la|de las|de los|de|den|der|del|el|al|von der|von|zu|du|des|di|da|le|la|bin|ibn"
_CUE_NAME = r"(?:naam is|name is|name ist|ich heiße|heiße|ich bin|m['’]appelle|me llamo|contact:|naam=|anders aan|groet(?:en)?,|regards,|Grüßen,?|Cordialement,|saludo,|sincerely,|Groeten,|mail van|letter from|Ansprechpartner:?|contacto:)\s*$"
_TITLE = r"(?:mevr\.|dhr\.|mw\.|de heer|Mrs\.|Mr\.|Ms\.|Miss|Frau|Herrn?|Mme|Madame|Monsieur|Sra\.|Sr\.|Srta\.|señora|señor)\s*$"
_CUE_ID = r"(?:bsn|burgerservicenummer|sofinummer|steuer-?(?:id|nummer|identifikationsnummer)|sécurité sociale|num[eé]ro fiscal|\bdni|\bnie|\bnif|seguridad social|social security|\bssn|passport|paspoort\w*|passeport|pasaporte|reisepass\w*|ausweis\w*|national insurance|tax(?:payer)? (?:id|number)|identit\w+)(?:\W*(?:number|nummer|nr\.?|no\.?|est|es|is|lautet|ist|le|numéro|número)\b){0,3}\W{0,3}$"
_CUE_PHONE = r"(?:\btel(?:\.|efoon|ephone|efon|éfono|=|:)?|bellen op|call me on|erreichen mich unter|appelez-moi au|llámeme al|☎|📞|\bT|mobiel|mobile|móvil|phone|/|\(|,)\W{0,3}$"
_NO_PHONE = r"(?:isbn(?:-1[03])?|bestelnummer|order number|bestellnummer|numéro de commande|número de pedido|order|commande|pedido|versie|version|rekening|iban|\bnr\.|\bno\.|fig\.|blz\.|p\.|€|\$)\W*(?:is|ist|est|es|:)?\W*$"
_CUE_ADDRESS = r"(?:bezorgadres:?|adres[=:]?|woon(?:t)? (?:op|aan)|live at|lives at|wohne|habite(?: au)?|vivo en|address:?|adresse:?|dirección:?|\bat)\W*$"
_CUES = {k: re.compile(v, re.IGNORECASE) for k, v in (("name", _CUE_NAME), ("title", _TITLE), ("id", _CUE_ID), ("phone", _CUE_PHONE), ("other", _NO_PHONE), ("address", _CUE_ADDRESS))}
_BAD_NAME = re.compile(r"(?:Huize|Stichting|Instituut|Institut|Universit\w+|Vereniging|Museum|School|College|Bibliothe\w+|Redacti\w+|Redaktion|Street|Road|Lane|Ave|Avenue|Rue|Calle|Straße|Weg|Uitgeverij|Verlag|Old|New|Saint|Sankt|Hotel|Café|Zaal|Bank)$")

# Each pattern of spans begins with the signs that a span can begin with, so that most places are passed over at once.
_UP, _LOW = "A-ZÀ-ÖØ-ÞŁŚŠŽ", "a-zßà-öø-ÿłśšž"
_PART_WORDS = "|".join(f"{p}|{p.upper()}|{p[0].upper()}{p[1:]}" for p in _PARTS.split("|"))
_SUR = f"(?:[Dd]['’])?[{_UP}][{_UP}{_LOW}'’]+(?:-[{_UP}][{_UP}{_LOW}'’]+)?"
_NAME = re.compile(f"(?=[{_UP}])(?<![\\w@.'’-])(?:(?P<given>[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?|[{_UP}]{{3,}})[  ](?P<mid>(?:[A-Z]\\.[  ]?){{0,3}})|(?P<init>(?:[A-Z]\\.[  ]?){{1,4}}))(?P<part>(?:(?:{_PART_WORDS})[  ]){{0,2}})(?P<sur>{_SUR})(?![\\w@])")
_LOWER_NAME = re.compile(f"(?:groet(?:en)?,\\n|regards,\\n|Grüßen,?\\n|Cordialement,\\n|saludo,\\n|naam=|contact: |mevr\\. |dhr\\. |Mrs?\\. |naam is |[Nn]ame is |Name ist |llamo |appelle |anders aan )(?P<name>(?P<given>[{_LOW}]{{3,}})(?: (?:[{_LOW}]\\.)+)?(?: (?:{_PARTS}))*(?: [{_LOW}][{_LOW}'’-]{{3,}})?)(?=\\n|[;,]| \\(| en ik| and I| et j| y ten| und ich| staat| at \\d|$)")
_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|apenstaart|arobase|arroba|ät)\s?[\])}]\s?|\s(?:at|apenstaart|apestaart|arobase|arroba)\s)"
_DOMAIN = r"(?:[A-Za-z0-9-]+(?:\.|\s?[\[({]\s?(?:dot|punt|point|punto|punkt)\s?[\])}]\s?|\s(?:dot|punt|point|punto|punkt)\s))+[A-Za-z]{2,}\b"
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9_])?" + _AT + _DOMAIN)
#: The end of every address; cheap, as it starts at a sign or word for "at".
_MAY_EMAIL = re.compile(_AT.replace(r"\s?@", "@").replace(r"\s?[\[({]", r"[\[({]") + _DOMAIN)
_PHONE = re.compile(r"(?=[\d+(])(?<![\w.,+-])(?:\+\d{1,3}[  .\-/]?|00\d{2}[  .\-/]?)?(?:\(\d{1,5}\)[  .\-/]?)?\d(?:[  .\-/]{0,2}\d){5,13}(?![\w])")
_ID = re.compile(r"(?=[\dA-Z])(?<![\w.+-])(?:\d{4}\.\d{2}\.\d{3}|\d{3}[ .]\d{3}[ .]\d{3}|\d{2} \d{3} \d{3} \d{3}|\d{3}[- ]\d{2}[- ]\d{4}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?|[XYZ]?\d{7,8}-?[A-Z]|[A-Z]{2}[A-Z0-9]\d[A-Z0-9]\d{4}|[A-Z]{2}[A-Z0-9]{6}\d|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{9}|\d{11}|\d{13,15}|[A-Z]\d{7,8}|[CFGHJKLMNPRTVWXYZ0-9]{9})(?!\w|[.,-]\d)")
_HOUSE = r"\d{1,4}(?:[  ]?(?:bis|ter|hs|huis)\b|[  ]?-[  ]?\d{1,3}\b|[  ]?[A-Za-z]\b(?!['’.])|\b)"
_ADDRESS = re.compile(
    f"(?=[\\d{_UP}])(?<![\\w-])(?:(?:\\d{{1,2}}e[  ])?(?:(?:Korte|Lange|Oude|Nieuwe|Grote|Kleine|Eerste|Tweede|Prins|Prinses|Koning|Koningin|Sint|Burgemeester|Dokter|Professor|Meester)[  ])?[{_UP}][{_LOW}'’-]*?(?:straat|laan|weg|pad|hof|kade|singel|plein|gracht|dijk|steeg|dreef|park|markt|baan|kamp|wal|haven|plantsoen|erf|weide|veld|oever|pleintje|straße|strasse|str\\.|platz|allee|gasse|ufer|damm|steig|ring|graben)[  ]{_HOUSE}"
    f"|(?:Laan|Plein|Weg|Hof|Kade|Park|Singel)[  ]van[  ](?:de[  ]|het[  ])?[{_UP}][{_LOW}-]+[  ]{_HOUSE}"
    f"|(?:Aan de|Aan het|Aan den|Achter de|Achter het|Op de|Op het|Onder de|Langs de|Voor de|Boven de|Tussen de)[  ][{_UP}][{_LOW}-]+[  ]{_HOUSE}"
    f"|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Hinter der|Unter den)[  ](?:[{_UP}][{_LOW}]+[  ])?[{_UP}][{_LOW}-]+[  ]{_HOUSE}"
    f"|\\d{{1,4}}[A-Za-z]?[  ](?:[{_UP}][{_LOW}'’]+[  ]){{1,3}}(?:Street|St\\.?|Road|Rd\\.?|Lane|Ln\\.?|Avenue|Ave\\.?|Drive|Close|Way|Court|Place|Square|Terrace|Row|Hill|Crescent|Gardens|Walk)(?!\\w)"
    f"|\\d{{1,4}}(?:[  ](?:bis|ter))?,?[  ](?:rue|avenue|quai|boulevard|bd|place|chemin|allée|impasse|cours|route|passage|sentier)[  ](?:de la |de l['’]|des |du |de |d['’])?[{_UP}][{_UP}{_LOW}'’-]+(?:[  ][{_UP}][{_LOW}-]+)*"
    f"|(?:Calle|Avenida|Avda\\.|Plaza|Paseo|Camino|Ronda|Travesía|C/)[  ](?:de la |del |de los |de las |de )?[{_UP}][{_LOW}]+(?:[  ][{_UP}][{_LOW}]+)*,?[  ](?:n\\.?º[  ]?)?{_HOUSE})"
)
_STREETISH = re.compile("(?:straat|laan|weg|pad|hof|kade|singel|plein|gracht|dijk|Lane|Road|Street|Ave)$")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _phone_shape(s: str) -> int:
    """1 for a number that is dialled so somewhere, -1 for one that can't be, 0 in between."""
    d = "".join(c for c in s if c.isdigit())
    if d.startswith(("978", "979")) and len(d) >= 10 or len(d) > 15 or len(d) < 7:
        return -1
    if s.startswith("+") or d.startswith("00") and len(d) >= 11:
        return 1
    if d.startswith("0") and 9 <= len(d) <= 12:
        return 1
    if re.fullmatch(r"(?:\(\d{3}\)[  ]?|\d{3}[-.  ])?\d{3}[-.]\d{4}", s):
        return 1
    if re.fullmatch(r"[5-9]\d\d[  ]\d{3}[  ]\d{3}", s):
        return 0
    return 0 if s[0] in "(" else -1


def candidates(text: str) -> list[tuple[str, int, int, list[int], str, bool]]:
    """(type, start, end, votes without the gazetteer's, given name, lower-case use) of every proposed span."""
    out: list[tuple[str, int, int, list[int], str, bool]] = []
    found: list[tuple[int, int]] = []

    def cue(kind: str, start: int, width: int = 48) -> int:
        return int(_CUES[kind].search(text, max(0, start - width), start) is not None)

    def line(start: int, end: int) -> int:
        return int((start == 0 or text[start - 1] == "\n") and (end == len(text) or text[end] == "\n"))

    after = 0
    for at in _MAY_EMAIL.finditer(text):
        # An address begins where the run of its signs does that ends before "at".
        begin = at.start()
        if begin > 0 and not text[begin].isspace() and text[begin - 1].isspace():
            begin -= 1
        while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
            begin -= 1
        m = _EMAIL.match(text, begin) if begin >= after else None
        if m:
            after = m.end()
            spelt = int("@" in m.group() or bool(re.search(r"[\[({]|dot|punt|point|punkt", m.group())))
            out.append(("email", m.start(), m.end(), [1 if spelt else -1, 1, 0, 0, 0, 0, 0, 0], "", False))
            found.append((m.start(), m.end()))
    for m in _ID.finditer(text):
        known = cue("id", m.start())
        shape = 0 if m.group().isdigit() else 1
        letters = any(c.isalpha() for c in m.group())
        other = cue("other", m.start())
        if known or (shape and not other and (letters and _digits(m.group()) >= 4 and len(m.group()) >= 9)):
            out.append(("id_number", m.start(), m.end(), [shape, known or -1, 0, 0, 0, 0, 0, -other], "", False))
            found.append((m.start(), m.end()))
    for m in _PHONE.finditer(text):
        number = m.group()
        while (shape := _phone_shape(number)) < 0 and (shorter := re.sub("[  .\\-/]+\\d+$", "", number)) != number:
            number = shorter  # a list number or another figure after it
        end = m.start() + len(number)
        announced = cue("phone", m.start(), 40)
        other = cue("other", m.start(), 40)
        if shape < 0 or cue("id", m.start()):
            continue
        out.append(("phone", m.start(), end, [shape, announced or line(m.start(), end), 0, 0, 0, 0, 0, -other], "", False))
        if shape:
            found.append((m.start(), end))
    for m in _ADDRESS.finditer(text):
        out.append(("address", m.start(), m.end(), [1, cue("address", m.start(), 30) or line(m.start(), m.end()), 0, 0, 0, 0, 0, 0], "", False))
        found.append((m.start(), m.end()))
    for m in _LOWER_NAME.finditer(text):
        if " " in m.group("name"):
            near = int(any(m.start() - 120 < b and a < m.end() + 160 for a, b in found))
            out.append(("name", m.start("name"), m.end("name"), [0, 1, 0, line(m.start("name"), m.end("name")), 0, 0, near, 0], m.group("given"), False))
    for m in _NAME.finditer(text):
        given, start = m.group("given") or "", m.start()
        if m.group("init") and m.group("init").startswith("M. ") and text[m.end() : m.end() + 3] == " a ":
            start += 3  # French "M." is a title
            if not re.match(f"(?:[A-Z]\\.|{_SUR})", text[start:]):
                continue
        end = m.end()
        if text[end - 1] in "'’":
            end -= 1
        near = int(any(start - 120 < b and a < end + 160 for a, b in found))
        against = -1 if given and _BAD_NAME.match(given) or _STREETISH.search(m.group("sur")) or any(a < end and start < b for a, b in found) else 0
        lower = bool(given) and re.search(f"(?<![\\w@.+-]){re.escape(given.lower())}(?![\\w@+_]|\\.\\w)", text) is not None
        out.append(("name", start, end, [0, cue("name", start), cue("title", start, 12), line(start, end), int(bool(m.group("init") or m.group("mid"))), int(bool(m.group("part"))), near, against], given.casefold(), lower))
    return out


_SPAN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pii_type", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("votes", T.ArrayType(T.ByteType())), T.StructField("given", T.StringType()), T.StructField("lower", T.BooleanType())])


def _propose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(d, kind, a, b, votes, given, lower) for d, t in zip(part["doc_id"], part["text"]) for kind, a, b, votes, given, lower in candidates(t)]
        yield pd.DataFrame(rows, columns=_SPAN.fieldNames())


def proposed(documents: DataFrame) -> DataFrame:
    """Candidate spans with all votes, kept in the checkpoint folder (spans only, no text).

    The gazetteer's vote: a given name is for if strong evidence (cue, title or own line) stands with at least STRONG_SHARE
    of its uses, against if it is mostly an ordinary word written in lower case too.
    """
    bounded_arrow_batches(documents.sparkSession)
    spans = kept(documents.where("text is not null and text <> ''").select("doc_id", "text").mapInPandas(_propose, _SPAN))
    strong = (F.get("votes", F.lit(1)) + F.get("votes", F.lit(2)) + F.get("votes", F.lit(3)) > 0).cast("int")
    known = spans.where("pii_type = 'name' and given <> ''").groupBy("given").agg(F.sum(strong).alias("strong"), F.sum(F.col("lower").cast("int")).alias("low"), F.count(F.lit(1)).alias("uses"))
    vote = F.when(F.col("low") > 0.2 * F.col("uses"), -1).when(F.col("strong") >= STRONG_SHARE * F.col("uses"), 1).otherwise(0)
    gazetteer = known.select("given", vote.cast("tinyint").alias("listed"))
    # Only spans with a given name meet the gazetteer: the others would all share one key.
    named = spans.where("given <> ''").join(sized_side(kept(gazetteer)), "given", "left")
    joined = named.unionByName(spans.where("given = ''").withColumn("listed", F.lit(None).cast("tinyint")))
    return joined.select("doc_id", "pii_type", "start_pos", "end_pos", F.concat("votes", F.array(F.coalesce("listed", F.lit(0).cast("tinyint")))).alias("votes"))


def label_model(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60) -> np.ndarray:
    """Posterior of each vote pattern by expectation-maximisation over independent labelers with rates of their own.

    The rates start where a vote for is more likely on a true span and a vote against on a false one, which fixes what the two
    hidden classes mean; the first guess stays in as PRIOR_SHARE of all spans, which keeps rates above zero.
    """
    n, k = votes.shape
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    start = {True: np.array([0.05, 0.5, 0.45]), False: np.array([0.3, 0.6, 0.1])}
    rate = {c: np.tile(start[c], (k, 1)) for c in (True, False)}
    share, posterior = prior, np.full(n, prior)
    for _ in range(rounds):
        score = {c: (seen * np.log(rate[c])[None]).sum(axis=(1, 2)) + np.log(share if c else 1 - share) for c in (True, False)}
        posterior = 1 / (1 + np.exp(np.clip(score[False] - score[True], -50, 50)))
        for c, weight in ((True, posterior * counts), (False, (1 - posterior) * counts)):
            total = (seen * weight[:, None, None]).sum(axis=0) + start[c] * PRIOR_SHARE * counts.sum()
            rate[c] = total / total.sum(axis=1, keepdims=True)
        share = float(np.clip((posterior * counts).sum() / counts.sum(), 0.02, 0.98))
    return posterior


def span_classifier(votes: np.ndarray, counts: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression on votes for and against, trained on the label model's posteriors; returns each pattern's probability."""
    x = np.concatenate([votes == 1, votes == -1, np.ones((len(votes), 1))], axis=1).astype(float)
    w, weight = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-4 * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


_PRIOR = {"name": 0.3, "email": 0.95, "phone": 0.85, "id_number": 0.85, "address": 0.9}


def pattern_scores(spans: DataFrame) -> DataFrame:
    """(pii_type, votes, score): one row per vote pattern. At most 3 ** VOTES patterns a type can reach the driver."""
    spark = spans.sparkSession
    rows = spans.groupBy("pii_type", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for kind in TYPES:
        own = sorted(((tuple(r["votes"]), r["n"]) for r in rows if r["pii_type"] == kind))
        if own:
            votes, counts = np.array([v for v, _ in own]), np.array([n for _, n in own], dtype=float)
            scores = span_classifier(votes, counts, label_model(votes, counts, _PRIOR[kind]))
            out += [(kind, list(map(int, v)), float(s)) for (v, _), s in zip(own, scores)]
    return spark.createDataFrame(out, "pii_type string, votes array<tinyint>, score double")


def find_pii(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, start_pos, end_pos, pii_type, score), without overlaps."""
    spans = proposed(documents)
    scored = spans.join(F.broadcast(pattern_scores(spans)), ["pii_type", "votes"]).where("score >= 0.5").select("doc_id", "start_pos", "end_pos", "pii_type", "score").distinct()
    w = Window.partitionBy("doc_id").orderBy("start_pos", F.col("end_pos").desc())
    # Spans of one document are few; islands of overlapping spans keep their best one.
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = scored.withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start_pos")).cast("int")).withColumn("island", F.sum("new").over(w))
    best = Window.partitionBy("doc_id", "island").orderBy(F.when(F.col("pii_type") == "name", 1).otherwise(0), F.round("score", 2).desc(), (F.col("start_pos") - F.col("end_pos")), "start_pos", "pii_type")
    return islands.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("doc_id", "start_pos", "end_pos", "pii_type", "score")


def masked(documents: DataFrame) -> DataFrame:
    """(doc_id, masked): each found span replaced by a placeholder of its type, all else unchanged; only documents with spans are joined."""
    spans = find_pii(documents).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "pii_type"))).alias("spans"))
    joined = documents.select("doc_id", "text").join(spans, "doc_id", "left")
    piece = F.expr("concat(transform(spans, (s, i) -> concat(substring(text, coalesce(get(spans, i - 1).end_pos, 0) + 1, s.start_pos - coalesce(get(spans, i - 1).end_pos, 0)), '<', upper(s.pii_type), '>')), array(substring(text, element_at(spans, -1).end_pos + 1)))")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(piece, "")).alias("masked"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal information in all documents."""
    return find_pii(table(spark, folder, "documents")).select("doc_id", "start_pos", "pii_type")


def p9_masked(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with placeholders."""
    return masked(table(spark, folder, "documents"))
