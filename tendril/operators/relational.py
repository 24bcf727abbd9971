"""Relational building blocks that Spark has no word for, as plans over its own operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import _fs, scratch, staged

#: Parts into which the rows of one name are cut where they meet others.
SLICES = 8
#: Edges of members to groups that make one more block of members.
CELL_EDGES = 3_000_000


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order. Make the order total, or which of equal rows stays is open."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; Catalyst keeps only k rows a key before the shuffle (WindowGroupLimit). With rank,
    that column has the place from 1."""
    name = rank or "_place"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def top_n_and_other(counts: DataFrame, key: str, n: str, most: int, other: str = "OTHER") -> DataFrame:
    """The most frequent keys, and one row for all the rest; null keys are part of the rest and never dropped."""
    top = counts.where(F.col(key).isNotNull()).orderBy(F.desc(n), key).limit(most).select(F.col(key).alias("_top"))
    named = counts.join(F.broadcast(top), F.col(key) == F.col("_top"), "left")
    return named.groupBy(F.coalesce("_top", F.lit(other)).alias(key)).agg(F.sum(n).alias(n))


def months_between(df: DataFrame, day: str) -> DataFrame:
    """Every month (first day) from the first to the last of df."""
    ends = df.agg(F.trunc(F.min(day), "month").alias("a"), F.trunc(F.max(day), "month").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def zero_filled_months(df: DataFrame, day: str, **aggregates: Column) -> DataFrame:
    """Aggregates by month over an unbroken calendar; months without rows have 0."""
    by_month = df.groupBy(F.trunc(day, "month").alias("month")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return months_between(df, day).join(by_month, "month", "left").na.fill(0, list(aggregates))


def mode_of(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The commonest non-null value of each key, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """The place of each row in an order over all rows, from 1, without a window over all rows in one task: ranges of the
    order are sorted on their own, and each begins after the number of rows before it. Make the order total."""
    sort = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    rows = sort.withColumns({"_part": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each partition
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_id", "_part", "_nth", "_before")


def capped_count(df: DataFrame, most: int) -> DataFrame:
    """How many rows, but at most `most`: the scan stops there."""
    return df.select(F.lit(1).alias("one")).limit(most).agg(F.count("*").alias("n"))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page of a keyset cursor: rows with a key below `after`, the greatest first."""
    rows = df if after is None else df.where(F.col(key) < F.lit(after))
    return rows.orderBy(F.desc(key)).limit(size)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, depth: int = 10_000) -> DataFrame:
    """A numbered page; beyond depth rows there is none."""
    start = (number - 1) * size
    return df.orderBy(*order).offset(start).limit(max(0, min(size, depth - start)))


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """Each row beside the number of all rows, without one window over all rows."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def hide_replaced(rows: DataFrame, key: str, *rules: tuple[Sequence[str], Column]) -> DataFrame:
    """Rows that no other row replaces. A rule is (columns that both rows share, condition on o and t); the right side is
    always the whole of rows, so a row hidden by a hidden row stays hidden, and a replacement outside rows hides nothing.
    """
    out = rows.alias("o")
    for shared, condition in rules:
        on = condition
        for c in shared:
            on = on & (F.col(f"o.{c}") == F.col(f"t.{c}"))
        out = out.join(rows.alias("t"), on & (F.col(f"o.{key}") != F.col(f"t.{key}")), "left_anti").alias("o")
    return out.select("o.*")


def mutual_single(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in which either side has no other partner."""
    na = pairs.groupBy(a).agg(F.count_distinct(b).alias("_na"))
    nb = pairs.groupBy(b).agg(F.count_distinct(a).alias("_nb"))
    return pairs.join(na.where("_na = 1"), a).join(nb.where("_nb = 1"), b).drop("_na", "_nb")


def resolve_chain(df: DataFrame, key: str, parent: str, depth: int = 8) -> DataFrame:
    """(key, head): follows parent pointers to the last row, `depth` steps at most. Pointers are doubled, so depth 8 takes
    three joins."""
    heads = df.select(F.col(key).alias("id"), F.coalesce(parent, key).alias("head"))
    steps = 1
    while steps < depth:
        up = heads.select(F.col("id").alias("head"), F.col("head").alias("next"))
        heads = heads.join(up, "head", "left").select("id", F.coalesce("next", "head").alias("head"))
        steps *= 2
    return heads.select(F.col("id").alias(key), "head")


def components(pairs: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """(id, component): the smallest id connected with each id, by alternating large-star and small-star steps until no
    edge changes. Every step is a written table."""
    edges = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = staged(edges, "star")
    before = None
    for _ in range(most):
        both = edges.where("u <> v").select(F.explode(F.expr("array(struct(u as u, v as v), struct(v as u, u as v))")).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.select("u", F.col("m").alias("v")).where("u <> v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.expr("array(struct(u as u, m as v), struct(v as u, m as v))")).alias("e")).select("e.*").where("u <> v").distinct()
        edges = staged(small, "star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not closed after {most} rounds")
    ids = pairs.select(F.explode(F.array(a, b)).alias("id")).where("id is not null").distinct()
    return ids.join(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def longest_levels(edges: DataFrame, node: str, before: str, roots: DataFrame, most: int = 1000) -> DataFrame:
    """(node, level): how many edges the longest way from a root has, for what can be reached; roots are at 0. A round is
    a level and holds each node once; later levels replace earlier ones. A circle, or more than `most` levels, is an
    error. Null ends count for nothing; no roots give no rows."""
    ways = edges.select(F.col(node).alias("_to"), F.col(before).alias("_from")).where("_to is not null and _from is not null").distinct()
    front = staged(roots.select(F.col(node).alias("_at")).where("_at is not null").distinct(), "front")
    levels = front.select(F.col("_at").alias(node), F.lit(0).cast("long").alias("level"))
    for k in range(1, most + 1):
        front = staged(ways.join(front, F.col("_from") == F.col("_at")).select(F.col("_to").alias("_at")).distinct(), "front")
        if front.isEmpty():
            return levels
        levels = levels.join(front, F.col(node) == F.col("_at"), "left_anti").unionByName(front.select(F.col("_at").alias(node), F.lit(k).cast("long").alias("level")))
        if k % 8 == 0:
            levels = staged(levels, "levels")
    raise RuntimeError(f"ways of more than {most} edges: a circle?")


def trigrams(text: Column) -> Column:
    """Set of trigrams: each word of letters and digits padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def trigram_pairs(df: DataFrame, key: str, text: str, block: Sequence[str], threshold: float, digits: int | None = None) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of rows of one block whose trigram sets have this Jaccard similarity, rounded to
    `digits` after it was held against the threshold. Prefix filter: of two such sets, the rarest few trigrams of one meet
    the rarest few of the other. Texts are compared once, however many rows bear them."""
    named = df.select(F.col(key).alias("id"), F.struct(*block, F.lower(text).alias("_text")).alias("name")).where(F.col("name._text").isNotNull())
    for c in block:
        named = named.where(F.col(f"name.{c}").isNotNull())
    grams = named.select("name").distinct().withColumn("g", trigrams(F.col("name._text"))).where(F.size("g") > 0)
    frequency = grams.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    rows = grams.select("name", F.size("g").alias("n"), F.explode("g").alias("t")).join(frequency, "t")
    place = F.row_number().over(Window.partitionBy("name").orderBy("f", "t"))
    prefix = rows.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("name", *[F.col(f"name.{c}").alias(c) for c in block], "n", "t")
    a, b = prefix.alias("a"), prefix.alias("b")
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.name") < F.col("b.name")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold)
    for c in block:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    met = a.join(b, on).select(F.col("a.name").alias("x"), F.col("b.name").alias("y")).distinct()
    both = met.join(grams.select(F.col("name").alias("x"), F.col("g").alias("u")), "x").join(grams.select(F.col("name").alias("y"), F.col("g").alias("v")), "y")
    common = F.size(F.array_intersect("u", "v"))
    alike = both.withColumn("similarity", common / (F.size("u") + F.size("v") - common)).where(F.col("similarity") >= threshold).select("x", "y", "similarity")
    alike = alike.unionByName(grams.select(F.col("name").alias("x"), F.col("name").alias("y"), F.lit(1.0).alias("similarity")))
    if digits is not None:
        alike = alike.withColumn("similarity", F.round("similarity", digits))
    # the rows of a name meet in slices, so that a usual name is not the work of one task; the number of partitions is
    # stated, since what is read here is small and what comes of it is not
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = alike.join(named.withColumnRenamed("name", "x"), "x").select("y", (F.col("x") == F.col("y")).alias("same"), "similarity", F.col("id").alias("i"), F.pmod(F.hash("id"), F.lit(SLICES)).alias("slice"))
    right = named.select(F.col("name").alias("y"), F.col("id").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    rows = left.repartition(n, "y", "slice").alias("l").join(right.repartition(n, "y", "slice").alias("r"), (F.col("l.y") == F.col("r.y")) & (F.col("l.slice") == F.col("r.slice")) & F.expr("i < j or i > j and not same"))
    return rows.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")


def neighbours(edges: DataFrame, member: str, group: str) -> DataFrame:
    """(member, partner, shared): members that share groups, and how many. A pair of members is counted from the smaller
    side once and mirrored."""
    one = edges.select(F.col(member).alias("m"), F.col(group).alias("g")).distinct()
    pairs = one.alias("a").join(one.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.m") < F.col("b.m"))).groupBy(F.col("a.m").alias("m"), F.col("b.m").alias("p")).agg(F.count("*").alias("shared"))
    return pairs.select(F.explode(F.expr("array(struct(m as m, p as p), struct(p as m, m as p))")).alias("e"), "shared").select(F.col("e.m").alias("member"), F.col("e.p").alias("partner"), "shared")


def meeting_pairs(edges: DataFrame, member: str, group: str, least: int) -> DataFrame:
    """(member, partner, shared), member < partner: whole numbers that share at least `least` groups, and how many. No
    pair is shuffled: members are written in blocks, and a task reads two blocks with their groups and counts all pairs
    between them, one member against the lists of its groups' members at a time. So disk holds each edge once."""
    spark = edges.sparkSession
    one = staged(edges.select(F.col(member).cast("long").alias("m"), F.col(group).alias("g")).where("m is not null and g is not null").distinct(), "edges")
    blocks = max(1, -(-one.count() // CELL_EDGES))
    ids = staged(one.select("g").distinct().select("g", F.monotonically_increasing_id().alias("k")), "groups")
    of_member = one.join(ids, "g").groupBy("m").agg(F.collect_list("k").alias("ks")).withColumn("block", F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("int"))
    path = scratch(spark, "blocks")
    of_member.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    filesystem, at_path = _fs(spark, path)
    uri = re.sub("^file:/+", "file:///", filesystem.makeQualified(at_path).toString())

    def block_of(number: int) -> pa.Table:
        files, base = pafs.FileSystem.from_uri(uri)
        infos = files.get_file_info(pafs.FileSelector(f"{base}/block={number}", allow_not_found=True))
        none = pa.table({"m": pa.array([], pa.int64()), "ks": pa.array([], pa.list_(pa.int64()))})
        tables = [none]
        for info in sorted(infos, key=lambda x: x.path):
            if info.base_name.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    tables.append(pq.read_table(f, columns=["m", "ks"], use_threads=False).cast(none.schema))
        return pa.concat_tables(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                yield from counted(*divmod(cell, blocks))

    def counted(low: int, high: int) -> Iterator[pa.RecordBatch]:
        if low > high:
            return
        same = low == high
        both = [block_of(high)] if same else [block_of(low), block_of(high)]
        right = np.repeat([True] if same else [False, True], [t.num_rows for t in both])
        t = pa.concat_tables(both).combine_chunks()
        if not t.num_rows:
            return
        m = t["m"].to_numpy()
        lists = pa.concat_arrays(t["ks"].chunks)
        sizes, ks = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        del t, both
        groups, k = np.unique(ks, return_inverse=True)
        k, row = k.astype(np.int32), np.repeat(np.arange(len(m), dtype=np.int32), sizes)
        del ks, lists
        order = np.argsort(m)
        place = np.empty(len(m), np.int32)  # members by size, so that those above one stand behind it
        of_right = order[right[order]]
        place[of_right] = np.arange(len(of_right), dtype=np.int32)
        names = m[of_right]
        listed = right[row]
        at, who = k[listed], place[row[listed]]
        by = np.lexsort((who, at))
        who, starts = who[by].astype(np.int64), np.searchsorted(at[by], np.arange(len(groups) + 1))
        first = np.concatenate([[0], np.cumsum(sizes)])
        out, held = [], 0
        for i in np.arange(len(m)) if same else np.flatnonzero(~right):
            lists = [who[starts[g] : starts[g + 1]] for g in k[first[i] : first[i + 1]]]
            shared = np.bincount(np.concatenate(lists), minlength=len(names))
            if same:
                shared[: place[i] + 1] = 0
            met = np.flatnonzero(shared >= least)
            if len(met):
                out.append((np.full(len(met), m[i]), names[met], shared[met]))
                held += len(met)
            if held > 100_000:
                yield _pairs(out)
                out, held = [], 0
        if out:
            yield _pairs(out)

    return spark.range(blocks * blocks, numPartitions=blocks * blocks).mapInArrow(run, "member long, partner long, shared long")


def _pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(n)], names=["member", "partner", "shared"])


def change_set(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Names of the fields that differ, in order; null, empty text and empty list are one."""
    empty = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.filter(F.array(*[F.when(~empty(before[n]).eqNullSafe(empty(after[n])), F.lit(n)) for n in before]), lambda x: x.isNotNull())


def validity(df: DataFrame, keys: Sequence[str], start: str, tie: str) -> DataFrame:
    """Adds valid_to: the start of the next row of the key."""
    return df.withColumn("valid_to", F.lead(start).over(Window.partitionBy(*keys).orderBy(start, tie)))


def upsert(held: DataFrame, came: DataFrame, key: str, values: Iterable[str]) -> DataFrame:
    """All rows after an upsert with the outcome of each key: new, changed, unchanged or kept."""
    values = list(values)
    h = held.select(key, *[F.col(v).alias(f"h_{v}") for v in values], F.lit(True).alias("is_held"))
    c = came.select(key, *[F.col(v).alias(f"c_{v}") for v in values], F.lit(True).alias("is_come"))
    both = h.join(c, key, "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"h_{v}").eqNullSafe(F.col(f"c_{v}"))
    outcome = F.when(F.col("is_held").isNull(), "new").when(F.col("is_come").isNull(), "kept").when(same, "unchanged").otherwise("changed")
    return both.select(key, *[F.when(F.col("is_come"), F.col(f"c_{v}")).otherwise(F.col(f"h_{v}")).alias(v) for v in values], outcome.alias("outcome"))


def k_anonymous(cells: DataFrame, member: str, cell: Sequence[str], least: int) -> DataFrame:
    """Members all of whose cells hold at least `least` members."""
    sizes = cells.groupBy(*cell).agg(F.count_distinct(member).alias("_n"))
    return cells.join(sizes, list(cell)).groupBy(member).agg(F.min("_n").alias("smallest_cell")).where(F.col("smallest_cell") >= least)
