"""Event windows for batches and streams alike, and stateful stream operators.

Functions take a DataFrame with ts, event_type, value, user_id, event_id. On a stream, give withWatermark first where
state must end; on a batch they are plain aggregations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def tumbling(events: DataFrame, width: str) -> DataFrame:
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    w = events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_deliveries(events: DataFrame, key: str, delay: str) -> DataFrame:
    """Each key once within the watermark: overlapping windows of a feed can be read again and again."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def late_policy(events: DataFrame, key: str, stamp: str, content: str) -> DataFrame:
    """(key, stamp, content, outcome) for each arrival of a stream: new, newer, stale (older than the newest stamp seen),
    or same (content that was held before). State of a key: its newest stamp and the contents' hashes."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest, hashes = state.get if state.exists else (None, [])
        held = set(hashes)
        for pdf in parts:
            pdf = pdf.sort_values([stamp, content])
            out = []
            for at, c in zip(pdf[stamp], pdf[content], strict=True):
                micros = int(pd.Timestamp(at).value // 1000)
                if newest is None:
                    outcome = "new"
                elif c in held:
                    outcome = "same"
                elif micros < newest:
                    outcome = "stale"
                else:
                    outcome = "newer"
                if outcome in ("new", "newer"):
                    newest = micros
                    held.add(c)
                out.append(outcome)
            yield pd.DataFrame({key: pdf[key], stamp: pdf[stamp], content: pdf[content], "outcome": out})
        state.update((newest, sorted(held)))

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"{key} {kinds[key]}, {stamp} {kinds[stamp]}, {content} {kinds[content]}, outcome string"
    return events.select(key, stamp, content).groupBy(key).applyInPandasWithState(step, schema, "newest bigint, hashes array<string>", "append", GroupStateTimeout.NoTimeout)


def alerts(searches: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of a batch that meet a saved search (event_type, least value) since it was last seen."""

    def run(batch: DataFrame, number: int) -> None:
        hits = batch.join(F.broadcast(searches), "event_type").where("value >= least and (seen is null or ts > seen)")
        sink(hits, number)

    return run


def quarantine(lines: DataFrame, text: str, schema: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Good records and bad lines. More than `most` bad lines are an error of the whole delivery."""
    read = lines.withColumn("_r", F.from_json(text, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = read.where("_r is null or _r._corrupt is not null").select(*lines.columns)
    if not lines.isStreaming and bad.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} bad records")
    return read.where("_r is not null and _r._corrupt is null").select("_r.*").drop("_corrupt"), bad
