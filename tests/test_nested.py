"""Shared inlining: the schema graph, the plan, and the rows."""

import json

from tendril.operators import nested as N

ROWS = [
    (1, json.dumps({"notice-title": {"pol": ["a", " ", None, "b"], "eng": "c"}, "classification-cpv": [["1"], [], ["2", "2"]], "buyer": {"name": "x", "seat": {"town": "t"}}})),
    (2, json.dumps({"notice-title": [{"lang": "deu", "text": "d"}, {"lang": "deu", "text": "e"}], "lots": {"lot-id": "L", "title": {"fra": {"value": "v", "auto": True}}, "classification-cpv": "9", "tenderers": {"name": "n", "address": {"town": "u"}}}})),
    (3, json.dumps({"lots": {"LOT-0001": {"title": {"pol": "p"}}, "LOT-0002": {"tenderers": [{"name": "q"}, {}, None]}}, "classification-cpv": None})),
    (4, None), (5, ""), (6, "{broken"), (7, "[1]"), (8, "{}"),
    (None, json.dumps({"notice-title": {"eng": "x"}})),
]


def test_plan(spark):
    plan = N.schema_graph(spark.createDataFrame(ROWS, "rec_id long, payload string"), "payload")
    assert {"notice-title", "classification-cpv", "title", "tenderers", "lots", N.ROOT} <= plan.tables
    assert "buyer" not in plan.tables and ("buyer", "seat", "town") not in plan.columns  # town has two parents: it is shared
    assert ("buyer", "name") not in plan.columns[N.ROOT]  # so has name
    assert "town" in plan.tables and "name" in plan.tables


def test_singletons_are_inlined_and_recursion_ends(spark):
    rows = [(1, json.dumps({"a": {"b": {"c": 5}}, "part": {"id": "1", "part": {"id": "2"}}}))]
    df = spark.createDataFrame(rows, "rec_id long, payload string")
    plan = N.schema_graph(df, "payload")
    assert plan.columns[N.ROOT] == [("a", "b", "c")] and "part" in plan.tables
    got = {(r.table_name, r.row_id, r.parent_table, r.parent_id): r.fields for r in N.shred(df, "rec_id", "payload", plan).collect()}
    assert got["record", 0, None, None] == {"a.b.c": "5"}
    assert got["part", 1, "record", 0] == {"id": "1"} and got["part", 2, "part", 1] == {"id": "2"}


def test_rows_and_positions(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "rec_id long, payload string, table_name string, pos string")
    plan = N.schema_graph(df, "payload")
    got = sorted((r.rec_id or 0, r.parent_key, r.table_name, r.entry_key, r.pos, r.value) for r in N.shred(df, "rec_id", "payload", plan, ["notice-title", "classification-cpv", "title", "tenderers"]).collect())
    assert got == [
        (0, "", "notice-title", "eng", 0, "x"),
        (1, "", "classification-cpv", "", 0, "1"), (1, "", "classification-cpv", "", 1, "2"), (1, "", "classification-cpv", "", 2, "2"),
        (1, "", "notice-title", "eng", 0, "c"), (1, "", "notice-title", "pol", 0, "a"), (1, "", "notice-title", "pol", 1, "b"),
        (2, "", "notice-title", "deu", 0, "d"), (2, "", "notice-title", "deu", 1, "e"),
        (2, "L", "classification-cpv", "", 0, "9"), (2, "L", "tenderers", "", 0, None), (2, "L", "title", "fra", 0, "v"),
        (3, "LOT-0001", "title", "pol", 0, "p"), (3, "LOT-0002", "tenderers", "", 0, None),
    ]


def test_empty_table(spark):
    df = spark.createDataFrame([], "rec_id long, payload string")
    plan = N.schema_graph(df, "payload")
    assert plan.tables == {N.ROOT} and N.shred(df, "rec_id", "payload", plan).count() == 0
