"""Schemas that drift between the files of a feed: what changed, and one table of all records.

Records are taken apart into cells (record, field, type, canonical text) on the JVM. Per file a profile remains: fields,
their types, nesting and a small sketch of the shapes of their values. Each file is matched with the one before by
similarity flooding: the schema graphs of both have nodes for fields, their types, nested parts and name words; pairs of
nodes reachable by edges of the same label form the connectivity graph; similarities start from names, value sketches
and the agreement of both fields on records that both files hold, and flow along that graph to a fixpoint. Fields of one
name correspond. Of the others, the converged similarity decides: measured by what fields of one name reach in the same
graph, pairs of LEAST or more are taken one to one, the greatest first; other values on shared records veto a pair. A record's fields are then named by following
the correspondences back, cast and put together.
"""

from __future__ import annotations

import math
import re
import statistics
import uuid
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import staged

#: Sketch size: value shapes are hashed into so many bits.
BITS = 64
#: Share of names in the start similarity of two fields; the converged similarity that a correspondence needs, that of
#: fields of one name being 1 (pairs that correspond reach 0.25 or more on the test tables, others 0.15 at most).
NAMES, LEAST = 0.3, 0.2
#: A field that both graphs have, to measure by where no other field keeps its name.
_ANCHOR = "f:\0"


def cells(records: DataFrame, keep: list[str], payload: str) -> DataFrame:
    """One row for each field that a record names, even as null: keep columns, `field`, `schema` (of the value), `kind`
    (string, number, boolean, list, object, null) and `text`, the value without what differs between ways of writing it
    (a single value in a list or a wrapper, a number in quotes). Broken JSON and other than objects have no cells."""
    parsed = records.select(*keep, F.try_parse_json(payload).alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    spark, view = records.sparkSession, f"tendril_{uuid.uuid4().hex}"
    parsed.createOrReplaceTempView(view)
    try:
        # outer, for a record of no fields must not fail; key is null then
        rows = spark.sql(f"select {', '.join(f'p.`{k}`' for k in keep)}, e.key as field, schema_of_variant(e.value) as schema, to_json(e.value) as json from {view} p, lateral variant_explode(p.v) e")
    finally:
        spark.catalog.dropTempView(view)
    s = F.col("schema")
    kind = F.when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object").when(s.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("string")
    bare = F.regexp_replace(F.regexp_replace("json", r'[\[\]{}"\\\s]', ""), "^value:", "")
    text = F.regexp_replace(F.translate(bare, ";", ","), r"(\.\d*?)0+$", "$1")
    text = F.regexp_replace(text, r"\.$", "")
    return rows.select(*keep, "field", "schema", kind.alias("kind"), F.when(kind != "null", text).alias("text"), "json")


def _words(name: str) -> list[str]:
    return re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())


def _grams(name: str) -> set[str]:
    padded = f" {' '.join(_words(name))} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)} or {padded}


def name_similarity(a: str, b: str) -> float:
    """Share of common trigrams of the names' words (Dice)."""
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def flood(left: list[tuple[str, str, str]], right: list[tuple[str, str, str]], start: dict[tuple[str, str], float], tolerance: float = 1e-4, most: int = 200) -> dict[tuple[str, str], float]:
    """Similarity flooding over two graphs given as (node, label, node): start similarities of node pairs, those at the
    fixpoint."""
    out: dict[tuple[str, str], list[tuple[str, str, str]]] = defaultdict(list)
    by_label: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    for side, edges in enumerate((left, right)):
        for a, label, b in edges:
            by_label[label][side].append((a, b))
    for label, (ls, rs) in by_label.items():
        for a, b in ls:
            for c, d in rs:
                out[a, c].append((label, b, d))
    weight: dict[tuple[tuple[str, str], tuple[str, str]], float] = defaultdict(float)
    into: dict[tuple, list] = defaultdict(list)
    for pair, targets in out.items():
        n: dict[str, int] = defaultdict(int)
        for label, *_ in targets:
            n[label] += 1
        for label, b, d in targets:
            weight[pair, (b, d)] += 1 / n[label]
            into[label, (b, d)].append(pair)
    for (label, pair), sources in into.items():
        for s in sources:
            weight[pair, s] += 1 / len(sources)
    sigma = dict(start)
    for p, q in list(weight):
        sigma.setdefault(p, start.get(p, 0.0))
        sigma.setdefault(q, start.get(q, 0.0))
    flows = list(weight.items())
    for _ in range(most):
        base = {k: start.get(k, 0.0) + v for k, v in sigma.items()}
        new = dict(base)
        for (p, q), w in flows:
            new[q] += w * base[p]
        top = max(new.values(), default=1.0) or 1.0
        new = {k: v / top for k, v in new.items()}
        moved = math.sqrt(sum((new[k] - sigma[k]) ** 2 for k in new))
        sigma = new
        if moved < tolerance:
            break
    return sigma


def _parts(schema: str) -> list[str]:
    """Names of the nested parts in a schema text such as OBJECT<code: STRING, town: STRING>."""
    return re.findall(r"[<,]\s*`?([\w-]+)`?: ", schema)


def _sketch(a: int, b: int) -> float:
    """Jaccard similarity of two sketches of value shapes."""
    return (a & b).bit_count() / max(1, (a | b).bit_count())


def _contradicted(both: int, equal: int) -> bool:
    return equal < 0.75 * both


def evidence(kind: str, like: float, agree: tuple[int, int, int]) -> float:
    """What the values say for two fields of one kind: like is the similarity of their sketches, agree on how many records
    of both files both are stated, on how many they are equal, and how many different values these are. Fields that
    differ on a quarter of the shared records are not one; few different values may agree by chance."""
    both, equal, values = agree
    if not both:
        return 0.5 * like if kind != "boolean" else 0.0
    if _contradicted(both, equal):
        return 0.0
    sure = 1 - 0.5 ** (equal / 3 if kind == "boolean" else values)
    return equal / both * (sure + (1 - sure) * 0.5 * like)


def match_fields(old: pd.DataFrame, new: pd.DataFrame, agree: dict[tuple[str, str], tuple[int, int, int]]) -> list[tuple[str, str]]:
    """Renamings (old name, new name) between two files' profiles (field, kind, schema, sketch); agree is as evidence()
    takes it, for pairs of a removed and an added field."""
    x, y = {r.field: r for r in old.itertuples()}, {r.field: r for r in new.itertuples()}
    gone, come = [f for f in x if f not in y], [f for f in y if f not in x]
    if not gone or not come:
        return []

    def graph(side: dict) -> list[tuple[str, str, str]]:
        edges = [("file", "field", _ANCHOR), *((_ANCHOR, "type", f"t:{k}") for k in sorted({r.kind for r in side.values()}))]
        for f, r in side.items():
            edges += [("file", "field", f"f:{f}"), (f"f:{f}", "type", f"t:{r.kind}")]
            edges += [(f"f:{f}", "part", f"p:{p}") for p in _parts(r.schema)]
            edges += [(f"f:{f}", "word", f"w:{w}") for w in _words(f)]
        return edges

    start: dict[tuple[str, str], float] = {("file", "file"): 1.0, (_ANCHOR, _ANCHOR): 1.0}
    for f, r in x.items():
        for g, q in y.items():
            if f == g:
                start[f"f:{f}", f"f:{g}"] = 1.0
            elif f in gone and g in come:
                bears = evidence(r.kind, _sketch(int(r.sketch), int(q.sketch)), agree.get((f, g), (0, 0, 0))) if r.kind == q.kind else 0.0
                start[f"f:{f}", f"f:{g}"] = NAMES * name_similarity(f, g) + (1 - NAMES) * bears
            for p in _parts(r.schema):
                for s in _parts(q.schema):
                    start[f"p:{p}", f"p:{s}"] = name_similarity(p, s)
            start[f"t:{r.kind}", f"t:{q.kind}"] = float(r.kind == q.kind)
    for a in {w for f in x for w in _words(f)}:
        for b in {w for f in y for w in _words(f)}:
            start[f"w:{a}", f"w:{b}"] = name_similarity(a, b)
    sigma = flood(graph(x), graph(y), start)
    kept = [sigma.get((f"f:{f}", f"f:{f}"), 0.0) for f in x if f in y] or [sigma.get((_ANCHOR, _ANCHOR), 0.0)]
    whole = statistics.median(kept) or 1.0
    # another type, or other values on shared records, is another field whatever surrounds it
    open_ = [(f, g) for f in gone for g in come if x[f].kind == y[g].kind and not _contradicted(*agree.get((f, g), (0, 0, 0))[:2])]
    # nor does structure alone make two fields one
    scores = ((sigma.get((f"f:{f}", f"f:{g}"), 0.0) / whole, f, g) for f, g in open_ if start[f"f:{f}", f"f:{g}"] > 0)
    out: dict[str, str] = {}
    for score, f, g in sorted(scores, key=lambda t: (-t[0], t[1], t[2])):
        if score >= LEAST and f not in out and g not in out.values():
            out[f] = g
    return list(out.items())


def report(records: DataFrame, feed: str, file: str, date: str, key: Column, payload: str) -> DataFrame:
    """Changes of field between consecutive files of each feed: feed, file, `change_kind` (added, removed, renamed,
    retyped), `field`, `new_field` ('' unless renamed).

    Files of a feed are ordered by date, then name. A field belongs to a file if one record names it. Its type there is
    the type of most of its non-null values (the first by name among equals); a field that is only null has none and is
    not retyped. Rows whose feed, file or date is null, or whose payload is no JSON object, count for nothing. Repeated
    rows change no result unless they change a majority. Other columns play no part; an empty table has no changes.
    """
    base = records.where(F.col(feed).isNotNull() & F.col(file).isNotNull() & F.col(date).isNotNull())
    base = base.select(F.col(feed).alias("feed"), F.col(file).alias("file"), F.col(date).alias("date"), key.alias("key"), F.col(payload).alias("payload"))
    all_cells = staged(cells(base, ["feed", "file", "date", "key"], "payload").drop("json"), "cells")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\d+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    bit = F.when(F.col("kind") != "null", F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(shape), F.lit(BITS)).cast("int")))
    kinds = all_cells.groupBy("feed", "file", "date", "field", "kind").agg(F.count("*").alias("n"), F.min("schema").alias("schema"), F.bit_or(bit).alias("bits"))
    rank = Window.partitionBy("feed", "file", "date", "field").orderBy(F.when(F.col("kind") == "null", 1).otherwise(0), F.desc("n"), "kind")
    everything = Window.partitionBy("feed", "file", "date", "field")
    profile = kinds.withColumn("nth", F.row_number().over(rank)).withColumn("sketch", F.coalesce(F.bit_or("bits").over(everything), F.lit(0).cast("long"))).where("nth = 1").select("feed", "file", "date", "field", "kind", "schema", "sketch")
    profile = staged(profile, "profile")
    files = profile.select("feed", "file", "date").distinct()
    before = Window.partitionBy("feed").orderBy("date", "file")
    steps = files.select("feed", F.lag("file").over(before).alias("prev"), F.lag("date").over(before).alias("prev_date"), "file", "date").where("prev is not null")
    now = steps.join(profile, ["feed", "file", "date"]).select("feed", "prev", "file", "field", F.col("kind").alias("new_kind"), F.col("schema").alias("new_schema"), F.col("sketch").alias("new_sketch"))
    then = steps.join(profile.select("feed", F.col("file").alias("prev"), F.col("date").alias("prev_date"), "field", "kind", "schema", "sketch"), ["feed", "prev", "prev_date"]).select("feed", "prev", "file", "field", "kind", "schema", "sketch")
    both = staged(then.join(now, ["feed", "prev", "file", "field"], "full"), "both")
    gone, come = both.where("new_kind is null").select("feed", "prev", "file", F.col("field").alias("old")), both.where("kind is null").select("feed", "prev", "file", F.col("field").alias("new"))
    # agreement on shared records, of removed against added fields only
    old_cells = all_cells.where("text is not null and key is not null").select("feed", F.col("file").alias("prev"), "key", F.col("field").alias("old"), F.col("text").alias("a"))
    new_cells = all_cells.where("text is not null and key is not null").select("feed", "file", "key", F.col("field").alias("new"), F.col("text").alias("b"))
    pairs = gone.join(come, ["feed", "prev", "file"])
    left = old_cells.join(pairs.select("feed", "prev", "file", "old").distinct(), ["feed", "prev", "old"]).distinct()
    right = new_cells.join(pairs.select("feed", "prev", "file", "new").distinct(), ["feed", "file", "new"]).distinct()
    met = left.join(right, ["feed", "prev", "file", "key"])
    agree = met.groupBy("feed", "prev", "file", "old", "new").agg(F.count("*").alias("n_both"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"), F.approx_count_distinct(F.when(F.col("a") == F.col("b"), F.col("a"))).alias("n_values"))
    # one row for each file with both removed and added fields: its profile and the agreement, as bounded as a schema
    fields = both.groupBy("feed", "prev", "file").agg(F.collect_list(F.struct("field", "kind", "schema", "sketch", "new_kind", "new_schema", "new_sketch")).alias("fields"))
    told = agree.groupBy("feed", "prev", "file").agg(F.collect_list(F.struct("old", "new", "n_both", "n_equal", "n_values")).alias("agree"))
    jobs = fields.join(pairs.select("feed", "prev", "file").distinct(), ["feed", "prev", "file"]).join(told, ["feed", "prev", "file"], "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                f = pd.DataFrame(list(r.fields))
                old = f[f["kind"].notna()][["field", "kind", "schema", "sketch"]]
                new = f[f["new_kind"].notna()][["field", "new_kind", "new_schema", "new_sketch"]].set_axis(["field", "kind", "schema", "sketch"], axis=1)
                told = {(a["old"], a["new"]): (a["n_both"], a["n_equal"], a["n_values"]) for a in (r.agree if r.agree is not None else [])}
                rows += [(r.feed, r.prev, r.file, a, b) for a, b in match_fields(old, new, told)]
            yield pd.DataFrame(rows, columns=["feed", "prev", "file", "field", "new_field"])

    # a row is few bytes and much work
    jobs = jobs.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "feed", "file")
    renamed = staged(jobs.mapInPandas(run, "feed string, prev string, file string, field string, new_field string"), "renamed")
    at = ["feed", "file"]
    out = renamed.select(*at, F.lit("renamed").alias("change_kind"), "field", "new_field")
    plain = lambda df, kind: df.select(*at, F.lit(kind).alias("change_kind"), "field", F.lit("").alias("new_field"))
    out = out.unionByName(plain(both.where("new_kind is null").join(renamed.select(*at, "field"), [*at, "field"], "left_anti"), "removed"))
    out = out.unionByName(plain(both.where("kind is null").join(renamed.select(*at, F.col("new_field").alias("field")), [*at, "field"], "left_anti"), "added"))
    out = out.unionByName(plain(both.where("kind <> new_kind and kind <> 'null' and new_kind <> 'null'"), "retyped"))
    return out.select(F.col("feed").alias(feed), F.col("file").alias(file), "change_kind", "field", "new_field")


def consistent(records: DataFrame, changes: DataFrame, feed: str, file: str, date: str, row_id: str, payload: str) -> DataFrame:
    """All records in one table: row_id, feed, file, and a column for each field under its first name in the feed, null
    where a record does not state it. Numbers are double, booleans boolean, everything else text (lists and objects as
    JSON); what cannot be cast to the type that most of a column's values have is null. changes is what report() gave.
    """
    base = records.select(F.col(feed).alias("feed"), F.col(file).alias("file"), F.col(date).alias("date"), F.col(row_id).alias("rid"), F.col(payload).alias("payload"))
    every = cells(base, ["feed", "file", "date", "rid"], "payload")
    renames = changes.where("change_kind = 'renamed'").select(F.col(feed).alias("feed"), F.col(file).alias("file"), F.col("field").alias("was"), F.col("new_field").alias("field"))
    files = base.select("feed", "file", "date").distinct()
    # names of a feed's fields file by file: a feed's renamings are as few as its files and fields
    steps = files.join(renames.groupBy("feed", "file").agg(F.collect_list(F.struct("was", "field")).alias("renames")), ["feed", "file"], "left")
    per_feed = steps.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("date", "file", "renames"))).alias("files"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                first: dict[str, str] = {}
                for f in r.files:
                    moved = {x["field"]: first.get(x["was"], x["was"]) for x in (f["renames"] if f["renames"] is not None else [])}
                    first = {k: v for k, v in first.items() if k not in moved} | moved
                    rows += [(r.feed, f["file"], k, v) for k, v in first.items() if k != v]
            yield pd.DataFrame(rows, columns=["feed", "file", "field", "name"])

    names = per_feed.mapInPandas(run, "feed string, file string, field string, name string")
    named = every.join(names, ["feed", "file", "field"], "left").withColumn("name", F.coalesce("name", "field"))
    named = staged(named.select("rid", "feed", "file", "name", "kind", F.when(F.col("kind").isin("list", "object"), F.col("json")).otherwise(F.col("text")).alias("text"), "json"), "named")
    kinds = named.where("kind <> 'null'").groupBy("name").pivot("kind", ["string", "number", "boolean", "list", "object"]).count().na.fill(0).collect()  # a row for each field name
    types = {r["name"]: "double" if r["number"] > max(r["string"], r["list"], r["object"], r["boolean"]) else "boolean" if r["boolean"] > max(r["string"], r["list"], r["object"], r["number"]) else "string" for r in kinds}
    plain = F.when(F.col("kind") == "string", F.regexp_replace("json", '^"|"$', "")).otherwise(F.col("text"))
    wide = named.withColumn("plain", plain).groupBy("rid", "feed", "file").pivot("name", sorted(types)).agg(F.max("plain"))
    cast = [(F.col(f"`{n}`").try_cast(t) if t != "string" else F.col(f"`{n}`")).alias(n) for n, t in sorted(types.items())]
    return wide.select(F.col("rid").alias(row_id), F.col("feed").alias(feed), F.col("file").alias(file), *[c for n, c in zip(sorted(types), cast, strict=True) if n not in (row_id, feed, file)])
