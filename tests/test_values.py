"""Values, periods, texts by language, natural persons: every branch."""

from pyspark.sql import functions as F

from tendril.functions import values as V


def test_choose_value(spark):
    rows = [
        (1, True, 100.0, 5.0, 7.0, [1.5, 2.5], ["EUR", "EUR"], 2), (2, True, 0.01, 50.0, 7.0, [], [], None), (3, False, 100.0, None, 70.0, [], [], None), (4, False, 100.0, None, None, [10.0], ["PLN"], 1),
        (5, False, None, None, None, [10.0, 20.5], [" eur", "EUR"], 2), (6, False, None, None, None, [10.0, 20.5], ["EUR", "PLN"], 2), (7, False, None, None, None, [10.0], ["EUR"], 3), (8, False, 1.0, None, None, [0.0], ["EUR"], 1),
        (9, False, 5e10, None, None, [], [], None), (10, False, 2e9, None, 1e6, [], [], None), (11, False, None, None, None, None, None, None), (12, True, 2e9, None, None, [1e6], ["EUR"], 1),
    ]
    df = spark.createDataFrame(rows, "k int, r boolean, t double, a double, e double, lots array<double>, c array<string>, n int")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    v = V.choose_value(F.col("r"), F.col("t"), F.col("a"), F.col("e"), empty(F.col("lots"), "array<double>"), F.lit("EUR"), empty(F.col("c"), "array<string>"), F.col("n"))
    got = {r.k: (r.v and (r.v.amount, r.v.currency, r.v.kind)) for r in df.select("k", v.alias("v")).collect()}
    assert got == {
        1: (100.0, "EUR", "total"), 2: (50.0, "EUR", "total"), 3: (70.0, "EUR", "estimated"), 4: (100.0, "EUR", "total"), 5: (30.5, "EUR", "lot_sum"), 6: (10.0, "EUR", "first_lot"), 7: (10.0, "EUR", "first_lot"),
        8: (None, None, "not_stated"), 9: (None, None, "implausible"), 10: (1e6, "EUR", "estimated"), 11: None, 12: (1e6, "EUR", "lot_sum"),
    }


def test_contract_period(spark):
    rows = [(1, ["2024-01-05", "2024-01-01"], ["2024-02-01", None], [10.0, 40.0], ["month", "DAY"], [0, 3]), (2, ["2024-05-01"], ["2024-01-01"], [2.5], ["YEAR"], [500]), (3, [], [], [3.0, 5.0], ["MONTH"], []), (4, [], ["2024-01-01"], [3.0, 5.0, 7.0], ["MONTH", "DAY"], None), (5, None, None, [7.0], ["FORTNIGHT"], None)]
    df = spark.createDataFrame(rows, "k int, s array<string>, e array<string>, v array<double>, u array<string>, r array<int>")
    days = lambda c: F.transform(c, lambda x: x.cast("date"))
    p = V.contract_period(days("s"), days("e"), F.col("v"), F.col("u"), F.col("r"))
    got = {r.k: tuple(None if x is None else str(x) for x in r.p) for r in df.select("k", p.alias("p")).collect()}
    assert got == {1: ("2024-01-01", "2024-02-01", "10", "MONTH", "3"), 2: ("2024-05-01", None, "30", "MONTH", None), 3: (None, None, "5", "MONTH", None), 4: (None, "2024-01-01", None, None, None), 5: (None, None, None, None, None)}


def test_texts_by_language(spark):
    rows = [('{"eng": "a", "deu": "b"}', "a"), ('{"eng": ["x", "y"]}', "x"), ('{"eng": [null, " ", "w"]}', "w"), ('{"eng": "[draft] t"}', "[draft] t"), ('{"eng": {"value": " z ", "auto": true}}', "z"), ('[{"lang": "deu", "text": "d"}, {"lang": "eng", "text": "e"}]', "e"), ('{"eng": " "}', None), ('{"deu": "b"}', None), (None, None), ("[]", None)]
    got = [r.t for r in spark.createDataFrame(rows, "b string, want string").select(V.in_language(F.col("b"), "eng").alias("t")).collect()]
    assert got == [w for _, w in rows]


def test_person_reason(spark):
    rows = [("Anna Maria Nowak", None, "person_name"), ("Nowak Sp. z o.o.", "12345678Z", None), ("Instalaciones García", "12345678-Z", "person_identifier"), ("", None, "person_marked"), (None, None, "person_marked"), ("osoba fizyczna", None, "person_marked"), ("Usługi Remontowe Jan Lis", None, "person_in_trading_name"), ("MIASTO ŁÓDŹ", None, None)]
    got = [r.x for r in spark.createDataFrame(rows, "n string, m string, w string").select(V.person_reason(F.col("n"), F.col("m")).alias("x")).collect()]
    assert got == [w for *_, w in rows]


def test_fold_keeps_what_is_no_separator(spark):
    from tendril.functions import scalar as S

    rows = [("Straße – Œuvre/Ærø", " strasse oeuvre aero"), ("Þór & Ðóra: Київ 東京", " thor & dora київ 東京"), ("Łódź.Șoseaua (ÎN)", " lodz soseaua in"), (None, " "), ("", " "), (" – ", " ")]
    df = spark.createDataFrame(rows, "t string, w string")
    assert [r.f for r in df.select(S.fold(F.col("t")).alias("f")).collect()] == [w for _, w in rows]
    assert [r.f for r in df.select(S.slug(F.col("t")).alias("f")).collect()][:2] == ["strasse-oeuvre-aero", "thor-dora"]


def test_levels_and_components_do_not_end_early(spark):
    import pytest

    from tendril.operators import relational as R

    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (4, 3), (9, 8), (5, None)], "n long, b long")
    roots = spark.createDataFrame([(1, "x"), (None, "x")], "n long, level string")
    assert sorted(map(tuple, R.longest_levels(edges, "n", "b", roots.select("n")).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    with pytest.raises(RuntimeError):
        R.longest_levels(spark.createDataFrame([(1, 1)], "n long, b long"), "n", "b", roots.select("n"), 3)
    with pytest.raises(RuntimeError):
        R.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long"), "a", "b", 1)
