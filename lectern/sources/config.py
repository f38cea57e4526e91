"""Small files of settings as rows or values: casts, rules, lexicon defaults, voice samples, environment files, job databases, JSON documents.

These are files of a few kilobytes that people edit, read on the driver; what they give is a DataFrame where data is joined with it.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEAKER = "id string, name string, kind string, role string, domains array<string>, tic_markers array<string>, exaggeration double, cfg_weight double, temperature double, speech_rate double"
LEXICON = "surface string, kind string, spoken string, lock boolean, note string"
#: Fixed value: a spoken line of a voice sample, with the tag in brackets or parentheses.
SAMPLE_LINE = "^\\s*[A-ZÀ-Ý_]+\\s*(?:\\[[^\\]]*\\]|\\([^)]*\\))?\\s*:\\s*(\\S.*)$"
#: Fixed value: identifiers of books, chapters and artifacts.
SAFE_ID = "^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$"


def _yaml(path: str) -> dict:
    import yaml

    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def read_cast(spark: SparkSession, hosts: str, guests: str | None = None) -> DataFrame:
    """Speakers of a cast; at least two hosts, among them an explainer and a skeptic, else ValueError. A missing guest file is an empty one."""
    people = [(p, "host") for p in _yaml(hosts).get("hosts") or []] + [(p, "guest") for p in (_yaml(guests).get("guests") or [] if guests else [])]
    roles = [p.get("role") for p, kind in people if kind == "host"]
    if len(roles) < 2 or not {"explainer", "skeptic"} <= set(roles):
        raise ValueError("a cast needs two hosts, an explainer and a skeptic among them")
    number = lambda p, k: None if p.get(k) is None else float(p[k])
    rows = [(str(p["id"]), str(p.get("name") or p["id"]), kind, str(p.get("role") or "expert"), list(map(str, p.get("domains") or [])), list(map(str, p.get("tic_markers") or [])), *(number(p, k) for k in ("exaggeration", "cfg_weight", "temperature", "speech_rate"))) for p, kind in people]
    return spark.createDataFrame(rows, SPEAKER)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(name, severity, pattern): banned phrases, trimmed and in lower case, as whole-word patterns, then the named patterns; invalid ones and empty phrases are left out."""
    data = _yaml(path)
    phrases = [str(p).strip().casefold() for p in data.get("phrases") or []]
    rows = [("banned_phrase", "blocking", rf"(?<!\w){re.escape(p)}(?!\w)") for p in dict.fromkeys(phrases) if p]
    for p in data.get("patterns") or []:
        try:
            re.compile(p["regex"])
        except (KeyError, TypeError, re.error):
            continue
        rows.append((str(p.get("name")), str(p.get("severity", "blocking")), p["regex"]))
    return spark.createDataFrame(rows, "name string, severity string, pattern string")


def read_lexicon_defaults(spark: SparkSession, path: str) -> DataFrame:
    """Entries every new lexicon starts with; a missing file gives none."""
    entries = _yaml(path).get("entries") or []
    rows = [(str(e["surface"]).strip(), str(e.get("kind") or "abbreviation"), str(e.get("spoken") or "").strip(), bool(e.get("lock", False)), e.get("note")) for e in entries if str(e.get("surface") or "").strip()]
    return spark.createDataFrame(rows, LEXICON)


def read_voice_samples(spark: SparkSession, path: str) -> DataFrame:
    """(text): what is spoken in the lines of voice samples."""
    return spark.read.text(path).select(F.trim(F.regexp_extract("value", SAMPLE_LINE, 1)).alias("text")).where("text <> ''")


def read_env(path: str, known: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines of an environment file without quotes; comments and lines without '=' are left out, keys that are known already win."""
    known = dict(os.environ) if known is None else known
    out: dict[str, str] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as file:
            for line in map(str.strip, file):
                key, sep, value = line.partition("=")
                if sep and not line.startswith("#") and key.strip() and key.strip() not in known:
                    out.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return out


def typed(settings: dict[str, str], key: str, default):
    """A setting with the type of its default; a boolean is true for 1, true, yes and on."""
    raw = settings.get(key)
    if raw is None or raw == "":
        return default
    return raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(raw)


def quality_passes(base: dict[str, str | None], quality: dict[str, str], on: bool) -> dict[str, str | None]:
    """Settings of the passes: in quality mode the passes that aren't set take the quality model."""
    return {k: (v if v is not None or not on else quality.get(k)) for k, v in base.items()}


def read_jobs(spark: SparkSession, path: str, table: str, where: str = "1", order: str = "rowid", limit: int | None = None) -> DataFrame:
    """Rows of a job database, all columns as text: a point or list read of the queue's own file."""
    if not re.fullmatch("[A-Za-z_]+", table):
        raise ValueError(f"not a table name: {table}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cursor = db.execute(f"select * from {table} where {where} order by {order}" + (f" limit {int(limit)}" if limit is not None else ""))
        names = [d[0] for d in cursor.description]
        rows = [tuple(None if v is None else str(v) for v in row) for row in cursor]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def write_document(row: dict, path: str) -> None:
    """One JSON document, indented by two, nulls kept; replaced in one step so that a reader never sees half of it."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as file:
        json.dump(row, file, ensure_ascii=False, indent=2, default=str)
    os.replace(part, path)


def safe_id(name: str) -> str:
    """The identifier itself; ValueError if it isn't one or climbs out of its folder."""
    if not re.match(SAFE_ID, name) or ".." in name:
        raise ValueError(f"not an identifier: {name!r}")
    return name


def inside(folder: str, name: str) -> str:
    """The path of an artifact below a folder; ValueError if it leads out of it."""
    path = os.path.realpath(os.path.join(folder, name))
    if os.path.commonpath([path, os.path.realpath(folder)]) != os.path.realpath(folder):
        raise ValueError(f"outside {folder}: {name!r}")
    return path


def strip_json_comments(text: str) -> str:
    """JSON without // and /* */ comments and without commas before a closing bracket; strings stay as they are."""
    pieces = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.DOTALL)
    bare = pieces.sub(lambda m: m.group() if m.group().startswith('"') else " ", text)
    return re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[\]}])', re.DOTALL).sub(lambda m: m.group(1) or "", bare)


def model_reference(text: str) -> tuple[str, str, str | None]:
    """provider, model and variant of 'provider/model#variant'."""
    provider, _, rest = text.partition("/")
    model, _, variant = rest.partition("#")
    if not provider or not model:
        raise ValueError(f"not provider/model: {text!r}")
    return provider, model, variant or None


def overlay(base: dict, change: dict) -> dict:
    """base with the values of change; where both have a dict, the same inside."""
    return base | {k: overlay(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in change.items()}
