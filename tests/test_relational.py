"""Building blocks against plain Python on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tendril.functions import scalar as S
from tendril.operators import relational as R


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(None, 5), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    find(5)
    got = {row.id: row.component for row in R.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_resolve_chain(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 9)]
    got = {r.id: r.head for r in R.resolve_chain(spark.createDataFrame(rows, "id long, up long"), "id", "up").collect()}
    assert got == {i: 0 for i in range(9)}


def test_top_n_and_other_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 1), (None, 9)], "k string, n long")
    assert {r.k: r.n for r in R.top_n_and_other(df, "k", "n", 2).collect()} == {"a": 5, "b": 4, "OTHER": 10}


def test_zero_filled(spark):
    df = spark.createDataFrame([("2020-01-05",), ("2020-04-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    assert [(str(r.month), r.n) for r in R.zero_filled_months(df, "d", n=F.count("*")).orderBy("month").collect()] == [("2020-01-01", 1), ("2020-02-01", 0), ("2020-03-01", 0), ("2020-04-01", 1)]


def test_hide_replaced_looks_at_all_rows(spark):
    df = spark.createDataFrame([(1, "b", 1), (2, "b", 2), (3, "b", 3), (4, "c", 1)], "id long, g string, v long")
    assert sorted(r.id for r in R.hide_replaced(df, "id", (["g"], F.col("t.v") == F.col("o.v") + 1)).collect()) == [3, 4]


def test_trigram_pairs(spark):
    names = [(i, "x", n) for i, n in enumerate(["alpha works", "alpha work", "beta", "betta", "", None, "alpha works"])]
    got = {(r.a, r.b) for r in R.trigram_pairs(spark.createDataFrame(names, "id long, b string, n string"), "id", "n", ["b"], 0.6).collect()}

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in (t or "").split() for i in range(len(w) + 1)}

    want = {(i, j) for i, _, a in names for j, _, b in names if i < j and grams(a) and grams(b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.6}
    assert got == want


def most_joined(node) -> int:
    """The rows that the largest join of an executed plan gave."""
    name = node.nodeName()
    if "AdaptiveSparkPlan" in name:
        return most_joined(node.executedPlan())
    if name.endswith("QueryStage"):
        return most_joined(node.plan())
    children = node.children()
    own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return max([own, *(most_joined(children.apply(i)) for i in range(children.size()))])


def test_trigram_pairs_of_copies_meet_once(spark):
    """Rows of one text meet for the result only, not once for every trigram that they share."""
    rows = [(i, "xy"[i % 2], ("alpha works", "Alpha work")[i % 3 == 0]) for i in range(240)] + [(900, None, "alpha works"), (901, "x", None)]
    found = R.trigram_pairs(spark.createDataFrame(rows, "id long, b string, n string"), "id", "n", ["b"], 0.6)
    got = found.collect()
    want = {(i, j) for i, b, _ in rows[:240] for j, c, _ in rows[:240] if i < j and b == c}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert {r.similarity == 1 for r in got if (r.a % 3 == 0) == (r.b % 3 == 0)} == {True} and {r.similarity < 1 for r in got if (r.a % 3 == 0) != (r.b % 3 == 0)} == {True}
    assert most_joined(found._jdf.queryExecution().executedPlan()) <= len(want)


@pytest.mark.parametrize("edges", [20, 100, 10_000])
def test_meeting_pairs(spark, monkeypatch, edges):
    """In one cell and in many: all pairs that share enough groups, each once, none of them shuffled."""
    monkeypatch.setattr(R, "CELL_EDGES", edges)
    r = random.Random(3)
    rows = [(r.choice([-5, 0, *range(1, 90)]) * 7, f"g{int(r.random() ** 2 * 40)}") for _ in range(900)] + [(None, "g0"), (1, None)]
    of = {}
    for m, g in rows:
        if m is not None and g is not None:
            of.setdefault(m, set()).add(g)
    want = {(a, b, len(of[a] & of[b])) for a in of for b in of if a < b and len(of[a] & of[b]) >= 3}
    found = R.meeting_pairs(spark.createDataFrame(rows, "m long, g string"), "m", "g", 3)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want) and len(want) > 200
    assert most_joined(found._jdf.queryExecution().executedPlan()) <= len(rows)
    assert R.meeting_pairs(spark.createDataFrame([], "m long, g string"), "m", "g", 3).count() == 0


def test_upsert(spark):
    held, came = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, v string")
    assert {(r.id, r.v, r.outcome) for r in R.upsert(held, came, "id", ["v"]).collect()} == {(1, "a", "kept"), (2, "c", "changed"), (3, None, "unchanged"), (4, "d", "new")}


def test_scalars(spark):
    df = spark.createDataFrame([(["35100000-1", "x 50200000 y", "35100000", "123"], "1 234,50", "Łódź, Straße!")], "c array<string>, a string, t string")
    r = df.select(S.cpv_clean(F.col("c")).alias("c"), S.amount(F.col("a")).alias("a"), S.fold(F.col("t")).alias("t"), S.amount(F.lit("1.00")).alias("p"), S.amount(F.lit("2.500.000,00")).alias("m"), S.redact(F.lit("a.b@c.pl or +48 123 456 789")).alias("r")).first()
    assert (r.c, r.a, r.t, r.p, r.m, r.r) == (["35100000", "50200000"], 1234.5, " lodz strasse!", None, 2500000.0, "[email] or [phone]")


def test_ranked(spark):
    r = random.Random(6)
    rows = [(i, r.choice([1.0, 2.0, 3.0, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = {x.id: x.place for x in R.ranked(df, [F.desc_nulls_last("v"), F.col("id")]).collect()}
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == {x[0]: i + 1 for i, x in enumerate(want)}
    assert R.ranked(df.where("false"), [F.col("id")]).count() == 0


def test_timeline(spark):
    from tendril.operators.timeline import amendments

    rows = [(1, 1, "f", "a"), (1, 2, "f", "a"), (1, 3, "f", "b"), (1, 4, "g", "x"), (1, 5, "f", "c"), (1, 6, "f", "b"), (1, 7, "f", None), (2, 1, "f", "q"), (None, 1, "f", "z")]
    got = sorted(amendments(spark.createDataFrame(rows, "e long, o long, field string, value string"), "e", ["o"], "field", "value").collect())
    assert got == [(1, 1, "f", "a", "b")]
