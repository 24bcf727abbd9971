"""Folding an entity's versions into the lines a reader sees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def amendments(rows: DataFrame, entity: str, order: list[str], field: str, value: str) -> DataFrame:
    """(entity, line, field, before, after): the amendments of each entity in order. A line that leaves its field's value
    as it was is none; a line that takes back the one just before it in the same field was a slip: both go, and the
    field's value is the one before them. The fold depends on order, so it runs over each entity's sorted rows in a
    stream and keeps only the values of its fields.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, lines = None, {}, []
        out: list[tuple] = []

        def flush() -> None:
            out.extend((now, i + 1, f, b, a) for i, (f, b, a) in enumerate(lines))

        for pdf in batches:
            for e, f, v in zip(pdf["e"], pdf["f"], pdf["v"], strict=True):
                if e != now:
                    flush()
                    now, state, lines = e, {}, []
                if f not in state:
                    state[f] = v
                elif v != state[f]:
                    if lines and lines[-1][0] == f and lines[-1][1] == v:
                        lines.pop()
                    else:
                        lines.append((f, state[f], v))
                    state[f] = v
            yield pd.DataFrame(out, columns=["e", "line", "field", "before", "after"])
            out = []
        flush()
        yield pd.DataFrame(out, columns=["e", "line", "field", "before", "after"])

    kind = rows.schema[entity].dataType.simpleString()
    known = rows.where(F.col(entity).isNotNull() & F.col(field).isNotNull() & F.col(value).isNotNull())
    sorted_rows = known.select(F.col(entity).alias("e"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(field).alias("f"), F.col(value).cast("string").alias("v")).repartition("e").sortWithinPartitions("e", *[f"o{i}" for i in range(len(order))])
    folded = sorted_rows.select("e", "f", "v").mapInPandas(run, f"e {kind}, line long, field string, before string, after string")
    return folded.withColumnRenamed("e", entity)
