"""Filling containers of fixed capacity with items of varying length.

Only lengths decide what goes together, and there are at most `capacity` of them. So the plan is made on the table of
lengths and their counts, whose size does not grow with the data: a *pattern* is a multiset of lengths and says how
often it is used. Exact-complement hashing makes the patterns: the largest length left opens one, larger lengths are
added while single, pair and triple sums cannot reach the gap, and then the index of single lengths, of pair sums and of
triple sums gives a combination that fills the gap exactly; it is consumed as often as the counts allow. What has no
exact complement is put together best-fit at the end. Items are then numbered within their length, in blocks so that
one very common length is no single task, and a number's place in the patterns is arithmetic.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import staged

#: Blocks by which the items of one length are numbered.
BLOCKS = 256


def _pair(avail: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two available lengths with sum gap, as even as possible. avail is indexed by length, so the complement of every
    length is looked up at once."""
    half = gap // 2
    if half < 1:
        return None
    low = np.arange(1, half + 1)
    need = np.where(low == gap - low, 2, 1)
    ok = (avail[low] >= need) & (avail[gap - low] >= need)
    at = np.flatnonzero(ok)
    return (int(low[at[-1]]), int(gap - low[at[-1]])) if len(at) else None


def _complement(avail: np.ndarray, gap: int) -> list[int] | None:
    """One to three available lengths with sum gap."""
    if gap < len(avail) and avail[gap]:
        return [gap]
    if two := _pair(avail, gap):
        return list(two)
    for c in np.flatnonzero(avail[: gap - 1])[::-1]:
        avail[c] -= 1
        two = _pair(avail, int(gap - c))
        avail[c] += 1
        if two:
            return [int(c), *two]
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, how often) that use up all counts; the sum of a pattern's lengths is at most capacity."""
    avail = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} does not fit into {capacity}")
        avail[size] += n
    patterns: list[tuple[list[int], int]] = []

    def times(lengths: list[int]) -> int:
        return min(int(avail[s]) // k for s, k in Counter(lengths).items())

    def use(lengths: list[int]) -> None:
        n = times(lengths)
        for s in lengths:
            avail[s] -= n
        patterns.append((lengths, n))

    rest = np.zeros_like(avail)
    while avail.any():
        largest = int(np.flatnonzero(avail)[-1])
        avail[largest] -= 1
        opened, gap = [largest], capacity - largest
        while gap:
            fits = np.flatnonzero(avail[: gap + 1])
            if not len(fits) or 3 * int(fits[-1]) >= gap:
                break
            s = int(fits[-1])
            avail[s] -= 1
            opened.append(s)
            gap -= s
        found = [] if not gap else _complement(avail, gap)
        for s in opened:
            avail[s] += 1
        if found is None:  # lengths only run out, so there will be no complement later either
            rest[largest] += avail[largest]
            avail[largest] = 0
        else:
            use(opened + found)
    avail = rest
    while avail.any():
        lengths: list[int] = []
        gap = capacity
        while gap and len(fits := np.flatnonzero(avail[: gap + 1])):
            lengths.append(int(fits[-1]))
            avail[lengths[-1]] -= 1
            gap -= lengths[-1]
        for s in lengths:
            avail[s] += 1
        use(lengths)
    return patterns


def fill(items: DataFrame, key: str, size: Column, capacity: int) -> DataFrame:
    """Puts every item into a container: `container` long, the key, `start_token` and `end_token` (the part of the item,
    end exclusive) and `place` (its order in the container from 0), int.

    An item longer than capacity, and only such an item, is split: full parts, then the rest. An item of length 0 takes
    no room and gets one row with null container and place. A null size counts as 0. Repeated keys are items of their
    own. An empty table gives an empty result.
    """
    spark = items.sparkSession
    sizes = staged(items.select(F.col(key).alias("item"), F.coalesce(size, F.lit(0)).cast("int").alias("n")), "sizes")
    parts = sizes.where("n > 0").select("item", F.explode(F.expr(f"sequence(0, n - 1, {capacity})")).alias("start_token"), "n")
    parts = parts.select("item", "start_token", F.least("n", F.col("start_token") + capacity).alias("end_token")).withColumn("size", F.expr("end_token - start_token"))
    block = F.pmod(F.xxhash64("item", "start_token"), F.lit(BLOCKS)).cast("int")
    parts = parts.withColumn("block", block)
    # at most capacity x BLOCKS rows, whatever the data
    blocks = staged(parts.groupBy("size", "block").agg(F.count("*").alias("n")), "blocks")
    patterns = plan({r["size"]: r["n"] for r in blocks.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)
    runs, filled, base = [], Counter(), 0
    for lengths, times in patterns:
        for place, s in enumerate(lengths):
            runs.append((s, filled[s], filled[s] + times, base - filled[s], place))
            filled[s] += times
        base += times
    runs_df = spark.createDataFrame(runs, "size int, low long, high long, shift long, place int")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("size", "block", before.alias("before"))
    order = Window.partitionBy("size", "block").orderBy("item", "start_token")
    ranked = parts.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(offsets), ["size", "block"])
    ranked = ranked.withColumn("nth", F.col("nth") + F.col("before"))
    placed = ranked.join(F.broadcast(runs_df), ["size"]).where("nth >= low and nth < high")
    out = placed.select((F.col("nth") + F.col("shift")).alias("container"), F.col("item").alias(key), "start_token", "end_token", "place")
    none = sizes.where("n <= 0").select(F.lit(None).cast("long").alias("container"), F.col("item").alias(key), F.lit(0).alias("start_token"), F.lit(0).alias("end_token"), F.lit(None).cast("int").alias("place"))
    return out.unionByName(none)
