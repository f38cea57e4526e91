"""Files of settings."""

import json
import sqlite3

import pytest

from lectern.sources import config as G


def test_cast_rules_and_samples(spark, tmp_path):
    hosts = tmp_path / "hosts.yaml"
    hosts.write_text("hosts:\n- {id: a, name: A, role: explainer, tic_markers: [kijk]}\n- {id: b, role: skeptic, exaggeration: 1}\n", encoding="utf-8")
    rows = {r["id"]: r for r in G.read_cast(spark, str(hosts), str(tmp_path / "none.yaml")).collect()}
    assert rows["a"]["tic_markers"] == ["kijk"] and rows["b"]["name"] == "b" and rows["b"]["exaggeration"] == 1.0
    hosts.write_text("hosts:\n- {id: a, role: explainer}\n", encoding="utf-8")
    with pytest.raises(ValueError):
        G.read_cast(spark, str(hosts))
    rules = tmp_path / "rules.yaml"
    rules.write_text("phrases: [' Kortom ', '', kortom]\npatterns:\n- {name: x, regex: 'a+'}\n- {name: bad, regex: '('}\n- {regex: b, name: y, severity: warning}\n", encoding="utf-8")
    assert [(r["name"], r["severity"]) for r in G.read_rules(spark, str(rules)).collect()] == [("banned_phrase", "blocking"), ("x", "blocking"), ("y", "warning")]
    assert G.read_rules(spark, str(tmp_path / "none.yaml")).count() == 0 and G.read_lexicon_defaults(spark, str(tmp_path / "none.yaml")).count() == 0
    samples = tmp_path / "samples.md"
    samples.write_text("# Kop\nWENDE [laughs]: Hallo daar.\n  TJALK: Ja.\nTJALK:\ngewoon: niet\n", encoding="utf-8")
    assert [r["text"] for r in G.read_voice_samples(spark, str(samples)).collect()] == ["Hallo daar.", "Ja."]


def test_settings(spark, tmp_path):
    env = tmp_path / ".env"
    env.write_text("# x\nA = '1'\nB=\"two\"\nC\nA=3\nD=on\n=\n", encoding="utf-8")
    got = G.read_env(str(env), {"B": "kept"})
    assert got == {"A": "1", "D": "on"} and G.typed(got, "A", 7) == 1 and G.typed(got, "D", False) is True and G.typed(got, "Z", 0.5) == 0.5
    assert G.quality_passes({"a": None, "b": "m"}, {"a": "q", "b": "q"}, True) == {"a": "q", "b": "m"}
    path = tmp_path / "jobs.db"
    with sqlite3.connect(path) as db:
        db.execute("create table jobs (id text, n int)")
        db.executemany("insert into jobs values (?, ?)", [("a", 1), ("b", None), ("c", 3)])
    assert [(r["id"], r["n"]) for r in G.read_jobs(spark, str(path), "jobs", "id > 'a'", "id desc", 2).collect()] == [("c", "3"), ("b", None)]
    G.write_document({"é": None, "n": [1]}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == '{\n  "é": null,\n  "n": [\n    1\n  ]\n}'
    assert json.loads(G.strip_json_comments('{"a": "x // y, }", /* b */ "c": [1, 2,], // end\n}')) == {"a": "x // y, }", "c": [1, 2]}
    assert G.model_reference("a/b#c") == ("a", "b", "c") and G.model_reference("a/b/c") == ("a", "b/c", None)
    assert G.overlay({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    assert G.safe_id("ch01.x") == "ch01.x" and G.inside(str(tmp_path), "x.json").endswith("x.json")
    for bad in ("../x", "a..b", "", "a/b"):
        with pytest.raises(ValueError):
            G.safe_id(bad)
    with pytest.raises(ValueError):
        G.inside(str(tmp_path), "../x")
