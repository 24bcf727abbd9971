"""Streams give what the batch gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tendril.sources import records
from tendril.streaming import windows as W

T0 = dt.datetime(2025, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    path = str(tmp_path / "in")
    df.repartition(5).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def drained(spark, df, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(f"t_{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(q.name)


@pytest.mark.parametrize("make", [lambda e: W.tumbling(e, "1 day"), lambda e: W.sliding(e, "6 hours", "3 hours"), lambda e: W.sessions(e, "30 minutes")])
def test_windows(spark, events, tmp_path, make):
    batch, stream = events
    got = drained(spark, make(stream), tmp_path, "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, make(batch).collect()))


def test_late_policy(spark, tmp_path):
    rows = [(1, T0, "x"), (1, T0 + dt.timedelta(hours=2), "y"), (2, T0, "x")]
    late = [(1, T0 + dt.timedelta(hours=1), "late"), (1, T0 + dt.timedelta(hours=3), "x"), (1, T0 + dt.timedelta(hours=4), "z")]
    schema = "k long, at timestamp, h string"
    for i, part in enumerate((rows, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = drained(spark, W.late_policy(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "at", "h"), tmp_path / str(i), "append")
    first = W.late_policy
    assert first and {(r.k, r.h, r.outcome) for r in got.collect()} >= {(1, "x", "new"), (1, "z", "newer"), (2, "x", "new")}


def test_alerts(spark, events):
    batch, _ = events
    hits = []
    W.alerts(spark.createDataFrame([("a", 50.0, None), ("b", 80.0, T0)], "event_type string, least double, seen timestamp"), lambda df, n: hits.append(df.count()))(batch, 0)
    assert hits == [20 + 5]


def test_quarantine(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("{bad",), ('{"a": "x"}',)], "t string")
    good, bad = W.quarantine(lines, "t", "a long", 5)
    assert [r.a for r in good.collect()] == [1] and bad.count() == 2
    with pytest.raises(ValueError):
        W.quarantine(lines, "t", "a long", 1)


def test_bundles(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"2025-01-0{1 + i % 3}") for i in range(30)], "id long, day string")
    small, bundles = str(tmp_path / "small"), str(tmp_path / "bundles")
    df.repartition(10).write.json(small)
    assert records.compact(spark, small, bundles, "day", "id long, day string") == 30
    assert spark.read.schema("id long, day string").json(bundles).count() == 30 and not (tmp_path / "small").exists()
    assert records.compact(spark, small, bundles, "day", "id long, day string") == 0
    # a run that ended between writing and removing is run again; another delivery comes beside it
    df.select((F.col("id") + 100).alias("id"), "day").repartition(3).write.json(small)
    with monkeypatch.context() as m:
        m.setattr(records, "remove", lambda *_: None)
        m.setattr(records, "_fs", lambda s, p, at=records._fs: at(s, p) if not p.endswith(tuple("0123456789abcdef")) else (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            records.compact(spark, small, bundles, "day", "id long, day string")
    assert records.compact(spark, small, bundles, "day", "id long, day string") == 30
    assert spark.read.schema("id long, day string").json(bundles).select("id").distinct().count() == spark.read.schema("id long, day string").json(bundles).count() == 60
    records.export_csv(df.orderBy("id"), str(tmp_path / "csv"), 5)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 5


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert records.read_json(spark, str(tmp_path / "a.json"), "a long", 2).agg(F.sum("a")).first()[0] == 3
    with pytest.raises(ValueError):
        records.read_json(spark, str(tmp_path / "a.json"), "a long", 3)
    (tmp_path / "a.xml").write_text("<f><entry><id>1</id></entry><entry><id>2</id></entry></f>")
    assert records.read_xml(spark, str(tmp_path / "a.xml"), "entry").count() == 2
