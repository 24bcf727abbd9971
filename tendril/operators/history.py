"""Versions of changing entities: history from snapshots, and its repair when late or corrected snapshots arrive.

`versions` builds the chains of whatever rows it is given. Windows run over (entity, block of time), so that an entity
that holds a third of all rows is many tasks; what one block hands to the next is a table of one row for each of them.

`HistoryStore` is the affected-chain rebuild: raw snapshots are kept as they came, in buckets of the entity's hash; an
update appends its rows, reads back the raw rows of touched entities only, rebuilds all their intervals, and swaps in the
buckets that hold them. Readers follow a manifest that is replaced by one rename, so they see all of an update or none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.session import _fs, remove


def versions(rows: DataFrame, entity: str, stamp: str, tie: str, attributes: dict[str, Column], block: str = "week") -> DataFrame:
    """Chains of versions: entity, the normalised attributes, `valid_from` and `valid_to` (null while current).

    Rows of an entity are taken in the order of stamp; of rows with one stamp the one with the greatest tie counts (of
    rows that agree in both, the greatest by attributes). An attribute that is null says nothing: the value before goes
    on. A version begins with the first row and wherever a value differs from the version before; a first stated value
    differs from none, and a return to an earlier state is a version of its own. Rows without entity or stamp are left
    out. Other columns, whatever their names, play no part. An empty table gives no versions.
    """
    names = [f"a{i}" for i in range(len(attributes))]
    raw = rows.select(F.col(entity).alias("k"), F.col(stamp).alias("at"), F.col(tie).alias("tie"), *[c.alias(n) for n, c in zip(names, attributes.values(), strict=True)])
    raw = raw.where("k is not null and at is not null")
    one = raw.groupBy("k", "at").agg(F.max(F.struct("tie", *names)).alias("s")).select("k", "at", *[F.col(f"s.{n}").alias(n) for n in names])
    one = one.withColumn("blk", F.date_trunc(block, "at"))
    inside = Window.partitionBy("k", "blk").orderBy("at")
    filled = [F.last(n, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names]
    state = one.select("k", "blk", "at", F.row_number().over(inside).alias("nth"), *filled)
    # what a block hands on: its last stated values
    ends = one.groupBy("k", "blk").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("at"))).alias(n) for n in names])
    before = Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("k", "blk", *[F.last(n, True).over(before).alias(f"{n}_before") for n in names], (F.count("*").over(before) > 0).alias("continues"))
    state = state.join(carried, ["k", "blk"])
    state = state.select("k", "blk", "at", "nth", "continues", *[F.coalesce(n, f"{n}_before").alias(n) for n in names], *[f"{n}_before" for n in names])
    same = F.lit(True)
    for n in names:
        previous = F.when(F.col("nth") == 1, F.col(f"{n}_before")).otherwise(F.lag(n).over(inside))
        same &= F.col(n).eqNullSafe(previous)
    begins = (F.col("nth") == 1) & ~F.col("continues")
    chain = state.withColumn("new", begins | ~same).where("new")
    # the end: the next beginning in the block, else the first of a later block
    firsts = chain.groupBy("k", "blk").agg(F.min("at").alias("first"))
    later = firsts.select("k", "blk", F.lead("first").over(Window.partitionBy("k").orderBy("blk")).alias("next_block"))
    chain = chain.withColumn("next_here", F.lead("at").over(inside)).join(later, ["k", "blk"])
    return chain.select(F.col("k").alias(entity), *[F.col(n).alias(name) for n, name in zip(names, attributes, strict=True)], F.col("at").alias("valid_from"), F.coalesce("next_here", "next_block").alias("valid_to"))


class HistoryStore:
    """Raw snapshots and the chains built from them, under one folder.

    raw/u=<update>/bucket=<b>/ holds what came; chains/<update>/bucket=<b>/ the chains; manifest.json says which update
    wrote the chains of each bucket, which updates count, and how many buckets there are. Everything else in the folder
    is a leftover of an update that did not end and is never read.

    There are as many buckets as keep them at ROWS raw rows or fewer on average: an update of n entities reads and
    rewrites n buckets of that size at most, however long history is. When they grow beyond, the buckets are doubled,
    which also puts the updates together; each row is rewritten a logarithmic number of times.
    """

    ROWS, LEAST = 2_000_000, 8

    def __init__(self, spark: SparkSession, path: str, entity: str, stamp: str, tie: str, attributes: dict[str, Column]):
        self.spark, self.path, self.entity, self.stamp, self.tie, self.attributes = spark, path.rstrip("/"), entity, stamp, tie, attributes

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.entity), F.lit(buckets)).cast("int")

    def manifest(self) -> dict:
        fs, p = _fs(self.spark, f"{self.path}/manifest.json")
        if not fs.exists(p):
            return {"updates": [], "chains": {}, "buckets": 0, "rows": 0}
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        fs, new = _fs(self.spark, f"{self.path}/manifest-{uuid.uuid4().hex}.json")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json"), options)

    def _raw(self, manifest: dict, buckets: Sequence[int]) -> DataFrame | None:
        """Raw rows of these buckets; the others are not opened."""
        if not manifest["updates"]:
            return None
        return self.spark.read.schema(self._schema).option("basePath", f"{self.path}/raw").parquet(*[f"{self.path}/raw/u={u}" for u in manifest["updates"]]).where(F.col("bucket").isin(list(buckets))).drop("u", "bucket")

    def _chains(self, manifest: dict, buckets: Sequence[int]) -> DataFrame | None:
        paths: dict[str, list[int]] = {}
        for b in buckets:
            if (u := manifest["chains"].get(str(b))) is not None:
                paths.setdefault(u, []).append(b)
        out = None
        for u, bs in sorted(paths.items()):
            part = self.spark.read.parquet(f"{self.path}/chains/{u}").where(F.col("bucket").isin(bs)).drop("bucket")
            out = part if out is None else out.unionByName(part)
        return out

    def apply(self, batch: DataFrame) -> dict[str, int]:
        """Takes in snapshots that may be new, late or corrected (a greater tie at a stamp that is there) and rebuilds
        the chains of the entities they touch."""
        manifest = self.manifest()
        update = f"{len(manifest['updates']):06d}-{uuid.uuid4().hex[:8]}"
        used = dict.fromkeys([self.entity, self.stamp, self.tie])
        cols = list(dict.fromkeys([*used, *(n for n in batch.columns if n in self._inputs(batch))]))
        rows = batch.select(*cols).where(F.col(self.entity).isNotNull() & F.col(self.stamp).isNotNull())
        self._schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])
        if not manifest["buckets"]:
            manifest["buckets"] = self._enough(rows.count())
        self._write_raw(rows, update, manifest["buckets"])
        came = self.spark.read.schema(self._schema).parquet(f"{self.path}/raw/u={update}")
        touched = came.select(self.entity, "bucket").distinct()
        hit = sorted(r[0] for r in touched.select("bucket").distinct().collect())  # at most as many numbers as buckets
        after = manifest | {"updates": [*manifest["updates"], update], "chains": dict(manifest["chains"]), "rows": manifest["rows"] + came.count()}
        if hit:
            keys = touched.select(self.entity)
            raw = self._raw(after, hit).join(keys, self.entity, "left_semi") if manifest["updates"] else came.drop("bucket")
            rebuilt = versions(raw, self.entity, self.stamp, self.tie, self.attributes)
            old = self._chains(manifest, hit)
            if old is not None:
                rebuilt = rebuilt.unionByName(old.join(keys, self.entity, "left_anti"))
            self._write_chains(rebuilt, update, after["buckets"])
            after["chains"] |= {str(b): update for b in hit}
        self._commit(after)
        if after["rows"] > self.ROWS * after["buckets"]:
            self._widen(after)
        return {"buckets": len(hit)}

    def _enough(self, rows: int) -> int:
        n = self.LEAST
        while n * self.ROWS < rows:
            n *= 2
        return n

    def _write_raw(self, rows: DataFrame, update: str, buckets: int) -> None:
        rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket", F.pmod(F.xxhash64(self.stamp), F.lit(4))).write.partitionBy("bucket").parquet(f"{self.path}/raw/u={update}")

    def _write_chains(self, chains: DataFrame, update: str, buckets: int) -> None:
        chains.withColumn("bucket", self._bucket(buckets)).repartition("bucket", F.pmod(F.xxhash64("valid_from"), F.lit(2))).write.partitionBy("bucket").parquet(f"{self.path}/chains/{update}")

    def _widen(self, manifest: dict) -> None:
        """More buckets for the same rows, swapped in by one manifest like an update."""
        old = [int(b) for b in manifest["chains"]]
        buckets = self._enough(manifest["rows"])
        update = f"{len(manifest['updates']):06d}-{uuid.uuid4().hex[:8]}"
        self._write_raw(self._raw(manifest, range(manifest["buckets"])), update, buckets)
        self._write_chains(self._chains(manifest, old), update, buckets)
        filled = [r[0] for r in self.spark.read.parquet(f"{self.path}/chains/{update}").select("bucket").distinct().collect()]
        self._commit({"updates": [update], "chains": {str(b): update for b in filled}, "buckets": buckets, "rows": manifest["rows"]})

    def _inputs(self, batch: DataFrame) -> set[str]:
        """Columns that the attributes read."""
        plan = batch.select(*[c.alias(n) for n, c in self.attributes.items()])
        refs = plan._jdf.queryExecution().analyzed().references().iterator()
        names = set()
        while refs.hasNext():
            names.add(refs.next().name())
        return names

    def history(self) -> DataFrame:
        manifest = self.manifest()
        out = self._chains(manifest, [int(b) for b in manifest["chains"]])
        if out is None:
            raise ValueError("no snapshot has been taken in yet")
        return out

    def drop(self) -> None:
        remove(self.spark, self.path)
