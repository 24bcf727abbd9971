"""Named queries over notices, feeds and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.catalog import query
from tendril.operators import drift, nested
from tendril.operators.history import HistoryStore
from tendril.session import scratch, table


def instant(text: Column) -> Column:
    """The instant that an ISO text states; without an offset it is UTC. Null if the text is none."""
    stated = F.trim(text)
    zoned = F.when(stated.rlike(r"(Z|[+-]\d\d:?\d\d)$") & stated.contains(":"), stated).otherwise(F.concat(F.when(stated.contains(":"), stated).otherwise(F.concat(stated, F.lit("T00:00:00"))), F.lit("Z")))
    return zoned.try_cast("timestamp")


def number(text: Column) -> Column:
    """The number that a text states, with blanks between thousands and point or comma before decimals."""
    bare = F.regexp_replace(text, r"[\s ]", "")
    return F.when(bare.rlike(r"^-?\d+,\d+$"), F.translate(bare, ",", ".")).otherwise(bare).try_cast("decimal(38,8)")


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def tender_attributes() -> dict[str, Column]:
    return {"title": one_space(F.col("title")), "status": F.col("status"), "deadline": instant(F.col("deadline")), "value_amount": number(F.col("value_amount"))}


def tender_history(spark: SparkSession, d: str) -> DataFrame:
    """History of the tenders: the collection up to the last 30 days is the first update, the rest, which holds new, late
    and corrected snapshots, the second."""
    lib = table(spark, d, "lib")
    store = HistoryStore(spark, scratch(spark, "history"), "tender_no", "retrievedAt", "snap_id", tender_attributes())
    last = lib.agg(F.max("loaded_at")).first()[0]
    cut = F.lit(last) - F.expr("interval 30 days") if last is not None else F.lit(None)
    late = F.coalesce(F.col("loaded_at") > cut.cast(lib.schema["loaded_at"].dataType), F.lit(False))
    store.apply(lib.where(~late))
    store.apply(lib.where(late))
    return store.history()


@query(
    "p7_found",
    r"""
with one as (
  select * from (select *, row_number() over (partition by tender_no, "retrievedAt" order by snap_id desc) rn from lib where tender_no is not null and "retrievedAt" is not null) where rn = 1),
filled as (
  select tender_no, "retrievedAt" as at_,
    last_value(trim(regexp_replace(title, '[\s]+', ' ', 'g')) ignore nulls) over w as t, last_value(status ignore nulls) over w as s,
    last_value(try_cast(deadline as timestamptz) ignore nulls) over w as d, last_value(try_cast(value_amount as decimal(38,8)) ignore nulls) over w as v
  from one window w as (partition by tender_no order by "retrievedAt" rows between unbounded preceding and current row)),
chain as (
  select *, lag(t) over w as lt, lag(s) over w as ls, lag(d) over w as ld, lag(v) over w as lv, row_number() over w as n
  from filled window w as (partition by tender_no order by at_)),
begun as (select tender_no, at_ from chain where n = 1 or t is distinct from lt or s is distinct from ls or d is distinct from ld or v is distinct from lv)
select tender_no, strftime(at_, '%Y-%m-%d %H:%M:%S') valid_from,
  coalesce(strftime(lead(at_) over (partition by tender_no order by at_), '%Y-%m-%d %H:%M:%S'), '') valid_to
from begun""",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.coalesce(F.substring(F.col(c).cast("string"), 1, 19), F.lit(""))
    return tender_history(spark, d).select("tender_no", text("valid_from").alias("valid_from"), text("valid_to").alias("valid_to"))


#: Tables of the notices' flat schema that hold entries, and what they are called in the result.
NOTICE_CHILDREN = {"notice-title": "title", "buyer-name": "buyer", "classification-cpv": "cpv", "title": "title", "tenderers": "tenderer"}


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    notices = table(spark, d, "ted_live_notices_2026_10")
    plan = nested.schema_graph(notices, "payload")
    rows = nested.shred(notices, "rec_id", "payload", plan, NOTICE_CHILDREN, columns=False)
    names = F.create_map(*[F.lit(x) for pair in NOTICE_CHILDREN.items() for x in pair])
    at_notice, at_lot = F.col("parent_table") == nested.ROOT, F.col("parent_table") == "lots"
    of_lot = F.col("table_name").isin("title", "classification-cpv", "tenderers")
    kept = rows.where((at_notice & F.col("table_name").isin("notice-title", "buyer-name", "classification-cpv")) | (at_lot & of_lot))
    child = names[F.col("table_name")]
    lang = F.when(child.isin("title", "buyer"), F.col("entry_key")).otherwise(F.lit(""))
    return kept.select("rec_id", F.col("parent_key").alias("lot_id"), child.alias("child"), lang.alias("lang"), "pos")


@query("p2_tenderers")
def p2_tenderers(spark: SparkSession, d: str) -> DataFrame:
    """One of the flat tables: tenderers with their inlined address and the lot they lie in."""
    notices = table(spark, d, "ted_live_notices_2026_10")
    plan = nested.schema_graph(notices, "payload")
    rows = nested.shred(notices, "rec_id", "payload", plan, ["tenderers"])
    flat = nested.flat_table(rows, "rec_id", plan, "tenderers")
    field = lambda n: F.col(f"`{n}`") if n in flat.columns else F.lit(None).cast("string")
    return flat.select("rec_id", F.col("parent_key").alias("lot_id"), "pos", field("name").alias("name"), field("address.country").alias("country"), field("address.town").alias("town"))


def _feed_changes(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "feed_records")
    stated = F.get_json_object("payload", "$.idweb"), F.get_json_object("payload", "$['publication-number']")
    key = F.when(F.col("feed_kind") == "boamp", stated[0]).otherwise(F.coalesce(*reversed(stated)))
    return drift.report(records, "feed", "file_name", "file_date", key, "payload")


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _feed_changes(spark, d)


@query("p3_table")
def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """All records of all feeds in one table under the first names of their fields."""
    return drift.consistent(table(spark, d, "feed_records"), _feed_changes(spark, d), "feed", "file_name", "file_date", "rec_id", "payload")
