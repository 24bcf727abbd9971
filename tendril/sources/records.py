"""Reading and writing records: JSON lines, XML entries, bundles by day, exports."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.session import _fs, remove


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, expected: int | None = None) -> DataFrame:
    """Records of JSON files, one to a line or as an array. With expected, another number of records is an error."""
    out = spark.read.schema(schema).option("multiLine", "true").json(path)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} records instead of {expected}")
    return out


def read_xml(spark: SparkSession, path: str, row: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Entries of XML feeds, one row for each element `row`."""
    reader = spark.read.format("xml").option("rowTag", row)
    return (reader.schema(schema) if schema else reader).load(path)


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Some columns of Parquet files; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def notice_body(notices: DataFrame, key: str = "rec_id", body: str = "donnees") -> DataFrame:
    """Main code and shape of the JSON text in a notice."""
    shape = F.when(F.col(body).startswith('{"OBJET": ['), "list").when(F.col(body).startswith('{"OBJET": {'), "object").when(F.col(body).startswith('{"EFORMS"'), "eforms")
    code = F.coalesce(*[F.get_json_object(body, p) for p in ("$.OBJET.CPV.PRINCIPAL", "$.OBJET[0].CPV[0]", "$.EFORMS.lot[0].cpv")])
    return notices.select(key, shape.alias("shape"), code.alias("cpv"))


def write_bundles(records: DataFrame, path: str, day: str, files_a_day: int = 1, mode: str = "append") -> None:
    """Gzipped JSON lines, bundled by day: files_a_day files for each."""
    salt = F.pmod(F.xxhash64(*records.columns), F.lit(files_a_day))
    records.repartition(day, salt).write.partitionBy(day).option("compression", "gzip").mode(mode).json(path)


def compact(spark: SparkSession, small: str, bundles: str, day: str, schema: T.StructType | str) -> int:
    """Bundles many small files by day, and removes them once the bundles hold as many records. Returns that number.

    May be run again wherever a run has ended: the bundles of a listing of files have a folder of their own, which is
    written anew, and the files leave their place in one rename. Without the folder there is nothing to do."""
    fs, here = _fs(spark, small)
    if not fs.exists(here):
        return 0
    files, names = fs.listFiles(here, True), []
    while files.hasNext():
        f = files.next()
        names.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    batch = hashlib.sha1("\n".join(sorted(names)).encode()).hexdigest()[:16]
    records = spark.read.schema(schema).json(small)
    n = records.count()
    write_bundles(records, f"{bundles}/batch={batch}", day, mode="overwrite")
    if spark.read.schema(schema).json(f"{bundles}/batch={batch}").count() != n:
        raise RuntimeError("the bundles do not hold all records; nothing was removed")
    done = f"{small.rstrip('/')}-done-{batch}"
    fs.rename(here, _fs(spark, done)[1])
    remove(spark, done)
    return n


def export_csv(rows: DataFrame, path: str, most: int = 5000) -> None:
    """A capped export with a header."""
    rows.limit(most).coalesce(1).write.option("header", "true").mode("overwrite").csv(path)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed rows of CSV files, trimmed, blank fields null."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns])
