"""Drift: flooding, the four kinds of change, and the consistent table."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendril.operators import drift as D

SCHEMA = "rec_id long, feed string, file string, date string, payload string, field string, kind string"


def test_flood_follows_structure():
    left = [("r", "child", "a"), ("r", "child", "b"), ("a", "type", "num"), ("b", "type", "text")]
    right = [("R", "child", "x"), ("R", "child", "y"), ("x", "type", "num"), ("y", "type", "text")]
    s = D.flood(left, right, {("r", "R"): 1.0, ("num", "num"): 1.0, ("text", "text"): 1.0})
    assert s["a", "x"] > s["a", "y"] and s["b", "y"] > s["b", "x"]


def test_names():
    assert D.name_similarity("source_schema", "schema_source") > 0.5 > D.name_similarity("montant", "devise")
    assert D.name_similarity("lotCount", "lot-count") == 1


def frame(spark, files):
    rows, n = [], 0
    for date, records in files:
        for r in records:
            n += 1
            rows.append((n, "f", f"{date}.json", date, r if isinstance(r, str) or r is None else json.dumps(r), "x", "y"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    got = D.report(df, "feed", "file", "date", F.get_json_object("payload", "$.id"), "payload")
    return sorted((r.file, r.change_kind, r.field, r.new_field) for r in got.collect())


def test_kinds(spark):
    a = [{"id": str(i), "objet": f"text {i}", "n": i, "old": f"v{i}", "gone": True} for i in range(8)]
    b = [{"id": str(i), "intitule": f"text {i}", "n": str(i), "old": f"v{i}", "fresh": None} for i in range(4, 12)]
    df = frame(spark, [("2025-02-01", b), ("2025-01-01", a), ("2025-01-01", [a[0], None, "{broken", "[1]"])])
    got = changes(df)
    assert got == [("2025-02-01.json", "added", "fresh", ""), ("2025-02-01.json", "removed", "gone", ""), ("2025-02-01.json", "renamed", "objet", "intitule"), ("2025-02-01.json", "retyped", "n", "")]
    table = D.consistent(df, D.report(df, "feed", "file", "date", F.get_json_object("payload", "$.id"), "payload"), "feed", "file", "date", "rec_id", "payload")
    rows = {r["rec_id"]: r for r in table.collect()}
    assert {r["objet"] for r in rows.values()} == {f"text {i}" for i in range(12)} and "intitule" not in table.columns


def test_same_contents_decide_over_like_names(spark):
    a = [{"id": str(i), "etat": f"e{i}"} for i in range(6)]
    b = [{"id": str(i), "etat_avis": f"q{i}", "zz": f"e{i}"} for i in range(6)]
    assert changes(frame(spark, [("1", a), ("2", b)])) == [("2.json", "added", "etat_avis", ""), ("2.json", "renamed", "etat", "zz")]


def test_values_written_otherwise_are_no_change(spark):
    a = [{"id": str(i), "x": f"v{i}"} for i in range(6)]
    b = [{"id": str(i), "y": [f"v{i}"] if i == 5 else f"v{i}"} for i in range(6)]
    assert changes(frame(spark, [("1", a), ("2", b)])) == [("2.json", "renamed", "x", "y")]


@pytest.mark.parametrize("files", [[], [("1", [{"id": "1"}])]])
def test_nothing_to_compare(spark, files):
    df = frame(spark, files) if files else spark.createDataFrame([], SCHEMA)
    assert changes(df) == []


def test_flooding_decides(spark, monkeypatch):
    a = [{"id": str(i), "objet": f"text {i}", "place": f"p{i}"} for i in range(8)]
    b = [{"id": str(i), "intitule": f"text {i}", "lieu": f"p{i}"} for i in range(8)]
    profile = lambda rows: pd.DataFrame([(f, "string", "STRING", 5) for f in rows[0]], columns=["field", "kind", "schema", "sketch"])
    agree = {("objet", "intitule"): (8, 8, 8), ("place", "lieu"): (8, 8, 8), ("objet", "lieu"): (8, 0, 0), ("place", "intitule"): (8, 0, 0)}
    assert sorted(D.match_fields(profile(a), profile(b), agree)) == [("objet", "intitule"), ("place", "lieu")]
    monkeypatch.setattr(D, "flood", lambda *_: {})
    assert D.match_fields(profile(a), profile(b), agree) == []


def test_fields_without_a_neighbour_that_stays():
    one = lambda f, sketch: pd.DataFrame([(f, "string", "STRING", sketch)], columns=["field", "kind", "schema", "sketch"])
    assert D.match_fields(one("objet", 3), one("intitule", 3), {("objet", "intitule"): (5, 5, 5)}) == [("objet", "intitule")]
    assert D.match_fields(one("objet", 3), one("intitule", 12), {("objet", "intitule"): (5, 1, 1)}) == []
    assert D.match_fields(one("objet", 3), one("intitule", 12), {}) == []
