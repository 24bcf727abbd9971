"""Personal data in free text: spans, and the same text with typed placeholders.

A character BiLSTM with CRF transitions (pii_model) tags every code point; it was trained by pii_train on the labelled
texts of pii_corpus and its weights are in models/pii.npz. Long texts are read in overlapping windows whose scores are
joined before one path is decoded over the whole text. What the tagger proposes is then checked for what its kind must
hold: an e-mail an at sign, a phone number seven digits, an address a number, a person's name two words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.llm import pii_model

MODEL = Path(__file__).parent / "models" / "pii.npz"
#: Texts tagged together in a worker.
TOGETHER = 2048
_TRIM = " \t\r\n,;:–()„”\"'"
#: A full stop ends a span only after an initial or an abbreviated name of one letter.
_STOP = re.compile(r"(?<![^\W\d_])[^\W\d_]\.$")


def weights() -> dict[str, np.ndarray]:
    return pii_model.load(str(MODEL))


def checked(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without surrounding blanks and separators, and only those that hold what their kind must hold."""
    out = []
    for a, b, kind in spans:
        while a < b and text[a] in _TRIM and not (kind == "PHONE" and text[a] == "("):
            a += 1
        while a < b and text[b - 1] in _TRIM and not (kind == "PHONE" and text[b - 1] == ")"):
            b -= 1
        while a < b and text[b - 1] in "." + _TRIM and not (kind == "PHONE" and text[b - 1] == ")") and not (kind == "PERSON_NAME" and _STOP.search(text[a:b])):
            b -= 1
        s = text[a:b]
        digits = sum(c.isdigit() for c in s)
        ok = {
            "EMAIL": lambda: re.search(r"@|\bat\b", s, re.I) and "." in s,
            "PHONE": lambda: 7 <= digits <= 15,
            "ID_NUMBER": lambda: 6 <= digits <= 15,
            "ADDRESS": lambda: digits > 0 and any(c.isalpha() for c in s),
            "PERSON_NAME": lambda: not digits and len(re.findall(r"[^\W\d_]+", s)) >= 2,
        }[kind]()
        if ok:
            out.append((a, b, kind))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(parts) + text[at:]


def find(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, kind, start_at, end_at): every span, in code points from 0, end exclusive. Spans of a text do not
    overlap. Null and empty texts have none; repeated rows have theirs each time; a text of any length is read whole.
    Other columns play no part."""
    p = rows.sparkSession.sparkContext.broadcast(weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [(i, kind, x, y) for i, spans in enumerate(pii_model.tag(p.value, texts)) for x, y, kind in checked(texts[i], spans)]
                if found:
                    i, kind, x, y = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(kind), pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=[row_id, "kind", "start_at", "end_at"])

    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{row_id}` {kind}, kind string, start_at int, end_at int")


def mask(rows: DataFrame, text: Column) -> Column:
    """Column of the text with each span replaced by its kind in brackets; null stays null."""
    p = rows.sparkSession.sparkContext.broadcast(weights())

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for at in range(0, len(texts), TOGETHER):
            some = texts.slice(at, TOGETHER).to_pylist()
            spans = pii_model.tag(p.value, [t or "" for t in some])
            out += [None if t is None else masked(t, checked(t, s)) for t, s in zip(some, spans, strict=True)]
        return pa.array(out, pa.string())

    return run(text)
