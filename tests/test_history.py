"""Histories: rules of versions, blocks of time, and the rebuild of affected chains."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tendril.operators.history import HistoryStore, versions
from tendril.session import scratch

SCHEMA = "e long, at timestamp, tie long, a string, b double, k string, blk string"
T0 = dt.datetime(2025, 1, 1)


def attributes():
    return {"a": F.col("a"), "b": F.col("b")}


def brute(rows):
    """The rules, row by row."""
    out = []
    by = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            by.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    for e, stamps in by.items():
        state, chain = None, []
        for at in sorted(stamps):
            r = max(stamps[at], key=lambda x: x[2])
            new = (r[3], r[4]) if state is None else tuple(n if n is not None else o for n, o in zip((r[3], r[4]), state))
            if state is None or new != state:
                chain.append((e, new, at))
            state = new
        for i, (e, values, at) in enumerate(chain):
            out.append((e, *values, at, chain[i + 1][2] if i + 1 < len(chain) else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.e, r.a, r.b, r.valid_from, r.valid_to) for r in df.collect()), key=str)


def some(seed, n=400):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, 3, None]), T0 + dt.timedelta(hours=r.randint(0, 2000)) if r.random() > 0.03 else None, i, r.choice(["x", "y", None]), r.choice([1.0, 2.0, None]), "k", "b") for i in range(n)]


@pytest.mark.parametrize("block", ["day", "week", "year"])
def test_versions_against_brute_force(spark, block):
    rows = some(1)
    got = versions(spark.createDataFrame(rows, SCHEMA), "e", "at", "tie", attributes(), block)
    assert rows_of(got) == brute(rows)


def test_nulls_returns_and_ties(spark):
    h = [T0 + dt.timedelta(days=i) for i in range(6)]
    rows = [(1, h[0], 1, "x", None), (1, h[1], 2, None, 5.0), (1, h[2], 3, "y", None), (1, h[3], 4, "x", None), (1, h[4], 9, "z", None), (1, h[4], 5, "w", None), (1, h[4], 9, "z", None)]
    got = rows_of(versions(spark.createDataFrame(rows, "e long, at timestamp, tie long, a string, b double"), "e", "at", "tie", attributes()))
    assert [(g[1], g[2], g[3], g[4]) for g in sorted(got, key=lambda g: g[3])] == [("x", None, h[0], h[1]), ("x", 5.0, h[1], h[2]), ("y", 5.0, h[2], h[3]), ("x", 5.0, h[3], h[4]), ("z", 5.0, h[4], None)]


def test_empty(spark):
    assert versions(spark.createDataFrame([], SCHEMA), "e", "at", "tie", attributes()).count() == 0


@pytest.mark.parametrize("most", [30, 2_000_000])
def test_store_late_and_corrected_rows(spark, monkeypatch, most):
    """With few rows to a bucket the store doubles its buckets on the way."""
    monkeypatch.setattr(HistoryStore, "ROWS", most)
    rows = some(2)
    r = random.Random(5)
    r.shuffle(rows)
    store = HistoryStore(spark, scratch(spark, "test"), "e", "at", "tie", attributes())
    for part in (rows[:250], rows[250:251], [], rows[251:]):
        store.apply(spark.createDataFrame(part, SCHEMA))
        got = rows_of(store.history())
    assert got == brute(rows) and store.manifest()["buckets"] == (16 if most == 30 else 8)
    # an update that touches one bucket leaves the chains of the others where they are
    before = store.manifest()["chains"]
    store.apply(spark.createDataFrame([(2, T0, 10_000, "late", None, "", "")], SCHEMA))
    after = store.manifest()["chains"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert rows_of(store.history()) == brute([*rows, (2, T0, 10_000, "late", None)])
    # an update that does not end changes nothing for readers
    spark.createDataFrame([(2, T0)], "e long, at timestamp").write.parquet(f"{store.path}/raw/u=000009-dead")
    assert rows_of(store.history()) == brute([*rows, (2, T0, 10_000, "late", None)])
