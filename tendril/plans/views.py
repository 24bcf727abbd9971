"""The domain's tables over the stand-in tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.session import table

#: All dates are held against this day.
AS_OF = "2000-01-01"

OPP = """opp as (select o_orderkey id, o_custkey buyer, o_orderstatus status, o_totalprice amount, cast(o_orderdate as date) published, o_orderpriority priority,
  cast(o_orderdate as date) + cast(case substr(o_orderpriority, 1, 1) when '1' then 14 when '2' then 21 when '3' then 30 when '4' then 45 else 60 end as integer) deadline from orders)"""
CODE = "concat(cast(30 + p_size % 25 as varchar), lpad(cast((p_partkey * 37) % 1000000 as varchar), 6, '0'))"
LINE = f"""line as (select l_orderkey id, l_suppkey winner, l_partkey part, l_linenumber nr, {CODE} code, l_extendedprice amount, l_discount discount, l_quantity quantity,
  l_returnflag kind, l_linestatus state, cast(l_shipdate as date) shipped from lineitem join part on p_partkey = l_partkey)"""


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    days = F.expr("case substr(o_orderpriority, 1, 1) when '1' then 14 when '2' then 21 when '3' then 30 when '4' then 45 else 60 end")
    published = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("buyer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), published.alias("published"), F.col("o_orderpriority").alias("priority"), F.date_add(published, days).alias("deadline"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    code = F.expr("concat(cast(30 + p_size % 25 as string), lpad(cast((p_partkey * 37) % 1000000 as string), 6, '0'))")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), code.alias("code"))
    item = table(spark, d, "lineitem").join(part, "l_partkey")
    names = {"l_orderkey": "id", "l_suppkey": "winner", "l_partkey": "part", "l_linenumber": "nr", "code": "code", "l_extendedprice": "amount", "l_discount": "discount", "l_quantity": "quantity", "l_returnflag": "kind", "l_linestatus": "state"}
    return item.select(*[F.col(a).alias(b) for a, b in names.items()], F.col("l_shipdate").cast("date").alias("shipped"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"))
    return table(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("winner"), F.col("s_name").alias("name"), "country", "region")


def buyers(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("family"))
    return table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("buyer"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "country", "family")


SUP = "sup as (select s_suppkey winner, s_name name, n_name country, n_regionkey region from supplier join nation on n_nationkey = s_nationkey)"
BUY = "buy as (select c_custkey buyer, c_name name, c_mktsegment segment, n_name country, n_regionkey family from customer join nation on n_nationkey = c_nationkey)"


def money(c) -> F.Column:
    """A sum that does not depend on order."""
    return F.round(F.sum(F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")).cast("double"), 2)


def sql_money(c: str) -> str:
    return f"round(cast(sum(cast({c} as decimal(18,2))) as double), 2)"
