"""Families of records: stars around heads, from pairs that no veto stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.session import staged


def stars(pairs: DataFrame, a: str, b: str, nodes: DataFrame, node: str, rank: str, most: int = 200) -> DataFrame:
    """(member, head): a row is a head or a member, never both; every member has a pair of its own with its head. Rows
    come in the order of (rank, node): one that is no member yet heads all its neighbours that are free.

    Taken in rounds: a free row that comes before all its free neighbours is a head, its free neighbours are members. At
    the end each member belongs to the first head among its neighbours. This is what one row after the other gives, in
    as many rounds as the longest chain of ever later neighbours. Pairs of a row with itself, with nulls or with rows
    that nodes does not hold count for nothing; a null rank comes last. An empty table has no stars. More than `most`
    rounds are an error.
    """
    order = F.struct(F.col(rank).isNull().alias("unknown"), F.col(rank).alias("rank"), F.col(node).alias("n"))
    of = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("n")).agg(F.min(order).alias("o"))
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    edges = both.join(of.select(F.col("n").alias("x"), F.col("o").alias("ox")), "x").join(of.select(F.col("n").alias("y"), F.col("o").alias("oy")), "y")
    every = edges = staged(edges, "edges")
    roles = None
    for _ in range(most):
        if edges.isEmpty():
            break
        heads = edges.groupBy("x").agg(F.min("oy").alias("first"), F.first("ox").alias("ox")).where("ox < first").select("x")
        members = edges.join(heads, "x", "left_semi").select(F.col("y").alias("t"), F.lit(False).alias("head")).distinct()
        taken = staged(members.unionByName(heads.select(F.col("x").alias("t"), F.lit(True).alias("head"))), "taken")
        roles = taken if roles is None else roles.unionByName(taken)
        edges = edges.join(taken.select(F.col("t").alias("x")), "x", "left_anti").join(taken.select(F.col("t").alias("y")), "y", "left_anti").select("x", "y", "ox", "oy")
        edges = staged(edges, "edges")
    else:
        raise RuntimeError(f"no end after {most} rounds")
    if roles is not None:
        to = every.join(roles.where("head").select(F.col("t").alias("x")), "x", "left_semi").join(roles.where("not head").select(F.col("t").alias("y")), "y", "left_semi")
        return to.groupBy(F.col("y").alias("member")).agg(F.min("ox").alias("h")).select("member", F.col("h.n").alias("head"))
    kind = nodes.schema[node].dataType
    return nodes.sparkSession.createDataFrame([], f"member {kind.simpleString()}, head {kind.simpleString()}")
