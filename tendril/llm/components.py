"""One group id for records that are linked directly or over others: seed-tree pruning.

Each round, every vertex proposes the smallest vertex of its neighbourhood to all of that neighbourhood. A vertex then
keeps edges only between its smallest proposal and the others, and if nobody proposed the vertex itself it is no local
minimum: it drops out of the graph and hangs on its smallest proposal in the propagation forest. The graph shrinks to
nothing in about log(n) rounds; the vertices that never dropped out are the seeds, and each is the smallest of its
component. Their ids then flow down the forest, last level first.

Each round and each level is a written table in the shared folder, so that a lost executor costs one round. All joins
are equi-joins whose one side has one row a vertex; a vertex with very many edges is a skewed key on the other side
only, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.session import staged

#: Rounds after which something is wrong; a chain of 10^12 vertices needs about 40.
MOST_ROUNDS = 100


def groups(pairs: DataFrame, a: str, b: str, linked: str = "true") -> DataFrame:
    """(id, group_id): every id of columns a and b once, with the smallest id of its component.

    linked is an SQL condition: a row for which it is not true links nothing, but its ids are listed all the same. Null
    ids are no ids and link nothing; repeated and reversed pairs and pairs of an id with itself are harmless. An empty
    table gives an empty result. Other columns play no part.
    """
    both = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.expr(linked).alias("linked"))
    ids = both.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    edges = both.where("linked and a is not null and b is not null and a <> b").select(F.explode(F.expr("array(struct(a as u, b as v), struct(b as u, a as v))")).alias("e")).select("e.u", "e.v").distinct()
    graph = staged(edges, "edges")
    forest: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        if graph.isEmpty():
            break
        # proposals: the minimum of a neighbourhood goes to all of it
        least = graph.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        to_neighbours = graph.join(least, "u").select(F.col("v").alias("w"), "m")
        proposals = to_neighbours.unionByName(least.select(F.col("u").alias("w"), "m")).distinct()
        proposals = staged(proposals, "proposals")
        best = proposals.groupBy("w").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("w")).alias("stays"))
        forest.append(staged(best.where("not stays").select(F.col("w").alias("id"), F.col("best").alias("parent")), "forest"))
        kept = proposals.join(best.select("w", "best"), "w").where("m <> best")
        graph = staged(kept.select(F.explode(F.expr("array(struct(m as u, best as v), struct(best as u, m as v))")).alias("e")).select("e.u", "e.v").distinct(), "edges")
    else:
        raise RuntimeError("the graph did not shrink")
    spark = pairs.sparkSession
    labels = spark.createDataFrame([], forest[0].select("id", F.col("parent").alias("group_id")).schema) if forest else ids.selectExpr("id", "id as group_id").where("false")
    for level in reversed(forest):
        roots = labels.select(F.col("id").alias("parent"), "group_id")
        down = level.join(roots, "parent", "left").select("id", F.coalesce("group_id", "parent").alias("group_id"))
        labels = labels.unionByName(staged(down, "labels"))
    return ids.join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
