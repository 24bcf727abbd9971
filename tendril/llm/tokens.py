"""Encoding of texts with a byte-level BPE rank file, and its inverse.

A text is cut before every space whose neighbours are both no white space of any kind. The tokenizer's own pattern starts
a new piece at exactly these places, so the parts can be encoded on their own. Parts repeat as words do:
a batch is turned into a dictionary of distinct parts, only these go through tiktoken, and the ids of all texts are put
together from them with array operations. Texts with a space beside other white space, or at an end, are encoded whole; runs of
white space long enough to exhaust the pattern engine are encoded as the one piece that the pattern makes of them.

Null and empty texts give the empty list. Ids are those of `encode_ordinary`: the strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public tokenizers' files; every function takes another.
TOKENIZERS = os.environ.get("TENDRIL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-splitting pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct parts that a worker remembers; when there are more it begins anew. This bounds memory, not results.
REMEMBERED = 400_000
LONG_BLANK = re.compile(r"\s{4096,}")


class Encoder:
    """Encodes Arrow batches. One lives in each Python worker."""

    def __init__(self, rank_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.seen: dict[str, list[int]] = {}

    def text(self, text: str) -> list[int]:
        """Ids of one text of any length."""
        if len(text) < 4096:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        at = 0
        for m in LONG_BLANK.finditer(text):
            # the pattern takes all of the run but its last character when a word follows
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.bpe.encode_ordinary(text[at : m.start()])
            out += self.bpe._core_bpe.encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + self.bpe.encode_ordinary(text[at:])

    def decode(self, ids) -> str:
        """The text of ids, by their raw bytes; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _part(self, part: str) -> list[int]:
        ids = self.seen.get(part)
        if ids is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            ids = self.text(part)
            if len(part) < 64:
                self.seen[part] = ids
        return ids

    def batch(self, texts: pa.Array, count: bool = False) -> pa.Array:
        """Lists of ids, or with count their lengths."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        lists = pc.split_pattern(texts, " ")
        off = np.asarray(lists.offsets, np.int64)
        parts = lists.flatten().dictionary_encode()
        off = off - off[0]
        index, words = np.asarray(parts.indices, np.int64), parts.dictionary.to_pylist()
        # texts with white space beside a space are encoded whole
        begins = np.array([not w or w[0].isspace() for w in words], bool)
        ends = np.array([not w or w[-1].isspace() for w in words], bool)
        inner = np.ones(len(index), bool)  # parts with a space before them
        inner[off[:-1]] = False
        before = np.concatenate([inner[1:], [False]]) if len(inner) else inner  # parts with a space behind them
        hit = np.concatenate([[0], np.cumsum(begins[index] & inner | ends[index] & before)])
        whole = (hit[off[1:]] > hit[off[:-1]]).nonzero()[0]
        known = len(words)
        head = np.zeros(len(index), bool)
        head[off[:-1]] = True
        first, at = np.unique(index[head], return_inverse=True)
        index = index.copy()
        index[head] = known + at  # a first part has no space before it
        keep = np.ones(len(index), bool)
        extra: list[list[int]] = []
        used = np.zeros(known, bool)
        if len(whole):
            for k, t in zip(whole, texts.take(pa.array(whole)).to_pylist(), strict=True):
                keep[off[k] + 1 : off[k + 1]] = False
                index[off[k]] = known + len(first) + len(extra)
                extra.append(self.text(t))
        sizes_kept = np.concatenate([[0], np.cumsum(keep)])
        off = sizes_kept[off]
        index = index[keep]
        used[index[index < known]] = True
        used_first = np.zeros(len(first), bool)
        f = index[(index >= known) & (index < known + len(first))] - known
        used_first[f] = True
        part = self._part
        ids = [part(" " + w) if u else () for w, u in zip(words, used.tolist(), strict=True)]
        ids += [part(words[w]) if u else () for w, u in zip(first.tolist(), used_first.tolist(), strict=True)]
        ids += extra
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        each = lens[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        if count:
            return pa.array((ends[off[1:]] - ends[off[:-1]]).astype(np.int32))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        source = np.repeat(starts[index] - ends[:-1], each)
        source += np.arange(len(source))
        out = pa.ListArray.from_arrays(pa.array(ends[off].astype(np.int32)), pa.array(flat[source]))
        assert len(out) == n
        return out


_ENCODER: dict[int, Encoder] = {}


def _encoder(ranks) -> Encoder:
    """The worker's encoder for a broadcast rank file."""
    key = hash(ranks.value)
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = Encoder(ranks.value)
    return _ENCODER[key]


def rank_file(vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    with open(os.path.join(folder or TOKENIZERS, f"{vocabulary}.tiktoken"), "rb") as f:
        return f.read()


def slices(texts: pa.Array, most: int = 32 << 20):
    """Runs of texts of about `most` bytes, so that memory does not follow the batch."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def ids(spark: SparkSession, text: Column, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Column of token ids (array<int>, never null) of a text column."""
    ranks = spark.sparkContext.broadcast(rank_file(vocabulary, folder))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        e = _encoder(ranks)
        return pa.concat_arrays([e.batch(t) for t in slices(texts)] or [pa.array([], pa.list_(pa.int32()))])

    return encode(text)


def count(spark: SparkSession, text: Column, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Column with the number of tokens (int, never null) of a text column."""
    ranks = spark.sparkContext.broadcast(rank_file(vocabulary, folder))

    @F.arrow_udf(T.IntegerType())
    def size(texts: pa.Array) -> pa.Array:
        e = _encoder(ranks)
        return pa.concat_arrays([e.batch(t, count=True) for t in slices(texts)] or [pa.array([], pa.int32())])

    return size(text)


def text_of(spark: SparkSession, ids: Column, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Column of the texts that lists of ids stand for; a null list gives null."""
    ranks = spark.sparkContext.broadcast(rank_file(vocabulary, folder))

    @F.arrow_udf(T.StringType())
    def decode(lists: pa.Array) -> pa.Array:
        e = _encoder(ranks)
        return pa.array([None if x is None else e.decode(x) for x in lists.to_pylist()], pa.string())

    return decode(ids)
