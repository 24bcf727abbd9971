"""Flat tables from deeply nested records: shared inlining.

A first pass over all records builds the schema graph: which element occurs below which, and how often at most. From
the graph follows the relational schema. An element gets a table of its own if it is the root, is repeated, occurs below
several elements (is shared), or occurs below itself (is recursive); every other element is a singleton and is inlined
as a column of the table of its nearest such ancestor. A second pass writes the rows, each with the id and the key of the
row it lies in.

Writers state the same content in several shapes. They are read as one element with entries: a list, nested lists, a
single value, an object whose keys are data (languages, lot numbers), a list of {key, text} objects, and an object that
only wraps a value. Null, empty and blank values are no entries.

The records hold any JSON, so the walk is in Python over Arrow batches; what leaves a worker is rows of the asked tables
with the asked columns only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = "record"


@dataclass(frozen=True)
class Shapes:
    """How writers spell collections: keys that are data, pairs of (key, text) fields, and fields that wrap a value."""

    key_patterns: tuple[str, ...] = (r"[a-z]{3}", r"[A-Z]+-\d+")
    pairs: tuple[tuple[str, str], ...] = (("lang", "text"),)
    wrappers: tuple[str, ...] = ("value", "code")
    #: Element -> its field that names an entry, where the key is not in the shape.
    natural_keys: tuple[tuple[str, str], ...] = (("lots", "lot-id"),)


class Walker:
    def __init__(self, shapes: Shapes):
        self.shapes = shapes
        self.keyed = re.compile("|".join(shapes.key_patterns)).fullmatch
        self.natural = dict(shapes.natural_keys)
        self.known: dict[tuple, str] = {}

    def kind(self, keys: tuple) -> str:
        """What an object with these keys is; 'pair k t', 'wrap k', 'keyed' or 'object'."""
        k = self.known.get(keys)
        if k is None:
            s = set(keys)
            pair = next((f"{a} {b}" for a, b in self.shapes.pairs if a in s and b in s), None)
            wrap = next((w for w in self.shapes.wrappers if w in s and not any(x.isupper() for x in w)), None)
            k = "keyed" if all(map(self.keyed, keys)) else f"pair {pair}" if pair else f"wrap {wrap}" if wrap and len(s) <= 2 else "object"
            if len(self.known) < 10_000:
                self.known[keys] = k
        return k

    def entries(self, v, key: str = "") -> Iterator[tuple[str, object]]:
        """The entries of an element's content, each with the key its shape gives it."""
        if v is None:
            return
        if isinstance(v, str):
            if v and not v.isspace():
                yield key, v
        elif isinstance(v, list):
            for x in v:
                yield from self.entries(x, key)
        elif isinstance(v, dict):
            if not v:
                return
            kind = self.kind(tuple(v))
            if kind == "object":
                yield key, v
            elif kind == "keyed":
                for k, x in v.items():
                    yield from self.entries(x, k)
            elif kind[:4] == "wrap":
                yield from self.entries(v[kind[5:]], key)
            else:
                _, k, t = kind.split(" ")
                yield from self.entries(v[t], str(v[k] or ""))
        else:
            yield key, v


@dataclass
class Edge:
    """What is known of a child below a parent: most entries in one parent, and whether they come keyed or listed."""

    most: int = 0
    many: bool = False
    nested: bool = False
    scalar: bool = False

    def add(self, other: Edge) -> None:
        self.most = max(self.most, other.most)
        self.many |= other.many
        self.nested |= other.nested
        self.scalar |= other.scalar


@dataclass
class Plan:
    """The relational schema: tables, and for each the inlined columns with their paths."""

    edges: dict[tuple[str, str], Edge]
    tables: set[str] = field(default_factory=set)
    columns: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        children: dict[str, list[str]] = {}
        parents: dict[str, set[str]] = {}
        for (p, c), _ in self.edges.items():
            children.setdefault(p, []).append(c)
            parents.setdefault(c, set()).add(p)
        below = {e: self._reach(e, children) for e in {*children, *parents}}
        self.tables = {ROOT}
        for (_, c), e in self.edges.items():
            if e.most > 1 or e.many or len(parents[c]) > 1 or c in below[c]:
                self.tables.add(c)
        for t in self.tables:
            self.columns[t] = sorted(self._inlined(t, children, ()))

    @staticmethod
    def _reach(start: str, children: dict[str, list[str]]) -> set[str]:
        seen: set[str] = set()
        todo = list(children.get(start, ()))
        while todo:
            e = todo.pop()
            if e not in seen:
                seen.add(e)
                todo += children.get(e, ())
        return seen

    def _inlined(self, at: str, children: dict[str, list[str]], path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for c in children.get(at, ()):
            if c not in self.tables:
                if self.edges[at, c].scalar:
                    yield (*path, c)
                yield from self._inlined(c, children, (*path, c))

    def leads_to(self, wanted: set[str]) -> set[str]:
        """Elements that have to be visited to reach the wanted tables."""
        out = set(wanted)
        grew = True
        while grew:
            grew = False
            for p, c in self.edges:
                if c in out and p not in out:
                    out.add(p)
                    grew = True
        return out


def _loads(text: str | None) -> dict | None:
    if text is None:
        return None
    try:
        v = json.loads(text)
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


def _graph_of(texts: Iterable[str | None], shapes: Shapes) -> dict[tuple[str, str], Edge]:
    walker, edges = Walker(shapes), {}

    def visit(element: str, obj: dict) -> None:
        for child, v in obj.items():
            e = edges.get((element, child))
            if e is None:
                e = edges[element, child] = Edge()
            if isinstance(v, str):
                if v:
                    e.scalar = True
                    e.most = e.most or 1
                continue
            n = 0
            for key, x in walker.entries(v):
                n += 1
                if key:
                    e.many = True
                if isinstance(x, dict):
                    e.nested = True
                    visit(child, x)
                else:
                    e.scalar = True
            if n > e.most:
                e.most = n
            if isinstance(v, list):
                e.many = True

    for t in texts:
        record = _loads(t)
        if record is not None:
            visit(ROOT, record)
    return edges


def schema_graph(records: DataFrame, text: str, shapes: Shapes = Shapes(), max_edges: int = 100_000) -> Plan:
    """The schema graph of all records and the plan that follows from it. Its size is that of the schema, not of the
    data; a collection whose keys are data but match no key pattern would break that, so more than max_edges edges are
    an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], Edge] = {}
        for b in batches:
            for k, e in _graph_of(b.column(0).to_pylist(), shapes).items():
                total.setdefault(k, Edge()).add(e)
            if len(total) > max_edges:
                raise ValueError(f"more than {max_edges} edges: a key pattern is missing")
        rows = [(p, c, e.most, e.many, e.nested, e.scalar) for (p, c), e in total.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["parent", "child", "most", "many", "nested", "scalar"])

    found = records.select(text).mapInArrow(run, "parent string, child string, most int, many boolean, nested boolean, scalar boolean")
    merged = found.groupBy("parent", "child").agg(F.max("most").alias("most"), *[F.max(c).alias(c) for c in ("many", "nested", "scalar")]).limit(max_edges + 1).collect()
    if len(merged) > max_edges:
        raise ValueError(f"more than {max_edges} edges: a key pattern is missing")
    return Plan({(r.parent, r.child): Edge(r.most, r.many, r.nested, r.scalar) for r in merged})


def shred(records: DataFrame, record_id: str, text: str, plan: Plan, tables: Iterable[str] | None = None, columns: bool = True, shapes: Shapes = Shapes()) -> DataFrame:
    """Rows of the tables: record_id, `table_name`, `row_id` (number in the record), `parent_table`, `parent_id`,
    `parent_key` (key of the row it lies in, '' at the top), `entry_key`, `pos` (place among the entries of the same
    record, parent key, table and entry key, from 0), and with columns also `value` (a scalar entry's text) and `fields`
    (map of inlined paths, joined by '.', to their texts; lists of singletons' values never occur there).

    A null, blank or broken text, and one that is no object, has no rows. A null record_id stays null. Repeated records
    give repeated rows. Other columns play no part. An empty table gives no rows.
    """
    wanted = set(plan.tables if tables is None else tables) & plan.tables
    visited, own, paths = plan.leads_to(wanted), plan.tables, plan.columns
    id_type = records.schema[record_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(shapes)
        natural = walker.natural
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            rec, out = [], [[] for _ in range(9 if columns else 7)]
            n_rows = 0
            for i, t in enumerate(texts.to_pylist()):
                record = _loads(t)
                if record is None:
                    continue
                places: dict[tuple, int] = {}
                number = 0

                def walk(obj: dict, element: str, at_table: str, at_id: int, at_key: str) -> None:
                    nonlocal number
                    for child, v in obj.items():
                        if child not in visited or v is None:
                            continue
                        table = child in own
                        name = natural.get(child)
                        for key, x in walker.entries(v):
                            nested = isinstance(x, dict)
                            if not table:
                                if nested:
                                    walk(x, child, at_table, at_id, at_key)
                                continue
                            number += 1
                            me = number
                            k = key or (str(x.get(name) or "") if name and nested else "")
                            if child in wanted:
                                slot = (at_table, at_key, child, k)
                                pos = places.get(slot, 0)
                                places[slot] = pos + 1
                                row = (child, me, at_table, at_id, at_key, k, pos)
                                if columns:
                                    row += (None if nested else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False), inlined(x, child) if nested else [])
                                rows.append(row)
                            if nested:
                                walk(x, child, child, me, k)

                def inlined(obj: dict, element: str) -> list[tuple[str, str]]:
                    found = []
                    for path in paths[element]:
                        v = obj
                        for p in path:
                            v = next((x for _, x in walker.entries(v.get(p))), None) if isinstance(v, dict) else None
                        if v is not None and not isinstance(v, dict):
                            found.append((".".join(path), v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)))
                    return found

                rows: list[tuple] = []
                if ROOT in wanted:
                    rows.append((ROOT, 0, None, None, "", "", 0) + ((None, inlined(record, ROOT)) if columns else ()))
                walk(record, ROOT, ROOT, 0, "")
                for row in rows:
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                rec += [i] * len(rows)
                n_rows += len(rows)
                if n_rows > 50_000:
                    yield batch(ids.take(pa.array(rec, pa.int64())), out)
                    rec, out, n_rows = [], [[] for _ in range(9 if columns else 7)], 0
            if n_rows:
                yield batch(ids.take(pa.array(rec, pa.int64())), out)

    names = [record_id, "table_name", "row_id", "parent_table", "parent_id", "parent_key", "entry_key", "pos", *(["value", "fields"] if columns else [])]
    arrow = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]

    def batch(ids: pa.Array, cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, arrow, strict=False)]], names=names)

    schema = f"`{record_id}` {id_type.simpleString()}, table_name string, row_id int, parent_table string, parent_id int, parent_key string, entry_key string, pos int" + (", value string, fields map<string,string>" if columns else "")
    return records.select(record_id, text).mapInArrow(run, schema)


def flat_table(rows: DataFrame, record_id: str, plan: Plan, name: str) -> DataFrame:
    """One of the tables with its own columns: the record, ids and keys, and a column for each inlined path."""
    cols: list[Column] = [F.col("fields")[".".join(p)].alias(".".join(p)) for p in plan.columns.get(name, [])]
    return rows.where(F.col("table_name") == name).select(record_id, "row_id", "parent_table", "parent_id", "parent_key", "entry_key", "pos", "value", *cols)
