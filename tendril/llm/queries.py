"""The named queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.llm.catalog import query
from tendril.session import table


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from tendril.llm import tokens

    return table(spark, d, "documents").select("doc_id", tokens.ids(spark, F.col("text")).alias("ids"))


@query("p9_containers")
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from tendril.llm import packing, tokens

    docs = table(spark, d, "documents").select("doc_id", "text")
    return packing.fill(docs, "doc_id", tokens.count(spark, F.col("text")), 2048)


@query(
    "p4_found",
    """
with recursive links as (
  select candidate a, head b from accept_merge_candidates where candidate is not null and head is not null and status is distinct from 'rejected'),
both_ways as (select a u, b v from links union select b, a from links),
ids as (select candidate id from accept_merge_candidates where candidate is not null union select head from accept_merge_candidates where head is not null),
reach(id, r) as (select id, id from ids union select reach.id, v from reach join both_ways on u = r)
select id org_id, min(r) group_id from reach group by id""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from tendril.llm import components

    links = table(spark, d, "accept_merge_candidates")
    found = components.groups(links, "candidate", "head", "status is null or status <> 'rejected'")
    return found.select(F.col("id").alias("org_id"), "group_id")


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from tendril.llm import reading

    docs = table(spark, d, "documents").select("doc_id", "text")
    read = docs.select("doc_id", reading.level(spark, F.col("text"), table(spark, d, "reading_samples")).alias("r"))
    return read.where("r.level is not null").select("doc_id", F.col("r.level").alias("level"))


def _number(text, order):
    """The number without what is only writing: prefix, kind of dash, blanks, leading zeros. Null if there is none."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    plain = F.transform(parts, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0")))
    return F.when(F.size(parts) >= 2, F.concat_ws("-", plain)).otherwise(F.nullif(F.upper(F.trim(text)), F.lit("")))


def _notices(spark: SparkSession, d: str) -> DataFrame:
    """Notices of both tables in one form; ids are 2 x rec_id, plus 1 for BOAMP, so that they rise with rec_id."""
    from tendril.llm.forest import folded

    json_text = lambda c: F.regexp_replace(F.regexp_replace(c, r'"[A-Za-z_]+"\s*:', " "), r"\\[nrtbf\"/]|\\u[0-9a-fA-F]{4}", " ")
    day = lambda c: F.datediff(F.substring(F.trim(c), 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date"))
    orgs = table(spark, d, "organisation")
    # one reading of the payload; what is no string comes as its JSON text
    fields = ("description-lot", "notice-title", "buyer-name", "buyer-identifier", "notice-type")
    ted = table(spark, d, "ted_live_notices_2026_10").withColumn("r", F.from_json("payload", ", ".join(f"`{f}` string" for f in fields)))
    description, title = json_text(F.col("r.description-lot")), json_text(F.col("r.notice-title"))
    unknown = lambda c: F.when(F.col("buyer_id").isNull(), c).otherwise(F.lit(""))
    name = unknown(folded(json_text(F.col("r.buyer-name"))))
    identifier = unknown(F.regexp_extract("r.buyer-identifier", r"([A-Z0-9]{5,})", 1))
    kind = F.coalesce("notice-type", "r.notice-type", F.lit(""))
    ted = ted.select(
        (F.col("rec_id") * 2).alias("id"), "batch_no", F.concat(F.lit("t"), _number(F.col("publication-number"), 1)).alias("number"), "buyer_id", name.alias("name"), identifier.alias("identifier"),
        F.coalesce(day(F.col("publication-date")), day(F.col("dispatch-date"))).alias("day"), F.coalesce(F.nullif(folded(description), F.lit("")), folded(title)).alias("text"), (F.lower(kind) == "corr").alias("own"), F.lit("t").alias("tbl"),
    )
    boamp = table(spark, d, "boamp_notices").select(
        (F.col("rec_id") * 2 + 1).alias("id"), "batch_no", F.concat(F.lit("b"), _number(F.coalesce(F.nullif(F.trim("idweb"), F.lit("")), "id"), 1)).alias("number"), "buyer_id", unknown(folded(F.col("nomacheteur"))).alias("name"), F.lit("").alias("identifier"),
        day(F.col("dateparution")).alias("day"), folded(F.concat_ws(" ", "objet", json_text(F.col("donnees")))).alias("text"), (F.upper(F.trim(F.coalesce("nature", F.lit("")))) == "RECTIFICATIF").alias("own"), F.lit("b").alias("tbl"),
    )
    both = ted.unionByName(boamp)
    # a buyer without id is looked up by number, else by name
    by_number = orgs.where("national_reg_no is not null").groupBy(F.col("national_reg_no").alias("identifier")).agg(F.min("organisation_id").alias("by_identifier"))
    by_name = orgs.groupBy(folded(F.col("canonical_name")).alias("name")).agg(F.min("organisation_id").alias("by_name"))
    both = both.join(by_number, "identifier", "left").join(by_name, "name", "left")
    buyer = F.coalesce(F.coalesce("buyer_id", "by_identifier", "by_name").cast("string"), F.nullif("name", F.lit("")))
    return both.withColumn("block", F.concat("tbl", buyer)).select("id", "batch_no", "number", "block", "day", "text", "own")


#: The last batch_no of each update but the last: a backlog and then ever smaller deliveries, so that runs are merged
#: between and a later update looks up merged ones.
UPDATES = (21, 31, 36, 39)


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries are taken in as updates of the index; rows without batch_no come with the first."""
    from tendril.llm.forest import new_forest

    notices = _notices(spark, d)
    index = new_forest(spark)
    out = None
    batch = F.coalesce("batch_no", F.lit(UPDATES[0]))
    for low, high in zip((None, *UPDATES), (*UPDATES, None), strict=True):
        part = notices if low is None else notices.where(batch > low)
        repeats = index.ingest(part if high is None else part.where(batch <= high))
        out = repeats if out is None else out.unionByName(repeats)
    tbl = F.when(F.col("id") % 2 == 0, "ted_live_notices_2026_10").otherwise("boamp_notices")
    return out.select(tbl.alias("tbl"), F.shiftright("first", 1).alias("first_id"), F.shiftright("id", 1).alias("rec_id"))


def _supplier_matches(spark: SparkSession, d: str):
    from tendril.llm import matching

    return matching.matches(table(spark, d, "supplier_dedupe"), "supplier_id", "name", "numbers", "country", "city")


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from tendril.llm import matching

    _, groups, member = _supplier_matches(spark, d)
    return matching.pairs_of_groups(groups, member)


@query("p1_pairs")
def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of profiles with the confidence that they are one company."""
    scored, _, _ = _supplier_matches(spark, d)
    return scored.select(F.col("p").alias("id_a"), F.col("q").alias("id_b"), F.round("confidence", 4).alias("confidence"))


def _personal_texts(spark: SparkSession, d: str) -> DataFrame:
    """(key, text) of both tables in one pass; the table is the lowest bit of the key."""
    orders = table(spark, d, "ezamowienia_status_cases").select("rec_id", F.col("orderObject").alias("text"), F.lit(0).alias("t"))
    names = table(spark, d, "supplier_dedupe").select(F.col("supplier_id").alias("rec_id"), F.col("name").alias("text"), F.lit(1).alias("t"))
    return orders.unionByName(names).select((F.col("rec_id") * 2 + F.col("t")).alias("key"), "text")


def _personal_row() -> list:
    tbl = F.when(F.col("key") % 2 == 0, "ezamowienia_status_cases").otherwise("supplier_dedupe")
    return [tbl.alias("tbl"), F.shiftright("key", 1).alias("rec_id")]


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from tendril.llm import pii

    found = pii.find(_personal_texts(spark, d), "key", "text")
    return found.select(*_personal_row(), "kind", "start_at", "end_at")


@query("p5_masked")
def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both tables with its masked text; null stays null."""
    from tendril.llm import pii

    rows = _personal_texts(spark, d)
    return rows.select(*_personal_row(), pii.mask(rows, F.col("text")).alias("text"))
