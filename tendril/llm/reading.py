"""Reading level of texts from interpolated n-gram models of texts of known level.

For every language and level a word bigram model, interpolated with its unigrams and a uniform floor, is trained on the
samples. The whole text is read, in windows of WINDOW words; the surprisals of its windows under each model are its
surprisal distributions, of which the mean of each and the deviation under the nearest model are kept. The language is
that of the model with the least mean, so a wrong or missing tag does not matter. The difficulty counts the steps of the
scale that lie below the text: a step between two levels counts by how much less the models above it are surprised than
those below it. Difficulties of held-out samples (each scored by models that have not seen it) and their levels are
joined by isotonic regression, which maps difficulty to level.

Words are compared after repair of doubly encoded characters, without markup, invisible characters, case and accents.
A text of fewer than MIN_WORDS words of running text (tokens of letters only) has no level: null, empty and blank texts,
stubs, and tables of codes, whose tokens hold digits or inner separators.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendril.llm.tokens import slices

WINDOW, MIN_WORDS = 12, 60
#: How soon a difference of mean surprisal (nats a word) counts as a whole step.
SHARPNESS = 2.0
#: Weight of bigrams against unigrams, and of seen unigrams against the uniform floor.
BIGRAM, UNIGRAM = 0.6, 0.97
_MARK = re.compile(r"<[^<>]*>|</?\w+|&[a-zA-Z]+;|&#\d+;")
_OTHER = str.maketrans({"ł": "l", "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "’": "'", "‘": "'", "ʼ": "'"})
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _repair(word: str) -> str:
    """Undoes UTF-8 that was read as a one-byte encoding; any other word stays."""
    try:
        raw = bytes(_CP1252.get(c) or ord(c) for c in word)
        return raw.decode("utf-8")
    except (ValueError, UnicodeDecodeError):
        return word


def word_of(token: str) -> tuple[str, bool]:
    """The compared form of a token, '' if there is none, and whether it is a word of running text."""
    if any("\x80" <= c <= "ÿ" for c in token):
        token = _repair(token)
    token = _MARK.sub("", token)
    token = "".join(c for c in token if unicodedata.category(c) not in ("Cf", "Cc"))
    folded = unicodedata.normalize("NFKD", token.casefold().translate(_OTHER))
    folded = "".join(c for c in folded if not unicodedata.combining(c))
    bare = folded.strip("".join(set(folded) - set("abcdefghijklmnopqrstuvwxyz0123456789")))
    if not bare:
        return "", False
    if any(c.isdigit() for c in bare):
        return "#", False
    inner = bare.replace("'", "").replace("-", "")
    return bare, inner.isalpha() and len(bare) > 0


def _words(text: str) -> list[str]:
    return [w for w, _ in map(word_of, text.split()) if w]


@dataclass
class Model:
    """Log probabilities of words under all models, as tables that batches gather from."""

    vocabulary: dict[str, int]  # word -> row; row 0 stands for all other words
    unigram: np.ndarray  # (words, models)
    context: np.ndarray  # (words, models): what a known context takes off an unseen pair
    pairs: np.ndarray  # sorted keys of seen pairs
    pair: np.ndarray  # (pairs, models)
    levels: np.ndarray  # (models,)
    languages: list[str]  # of the models
    steps: tuple[list[float], list[float]] = ((), ())  # isotonic: difficulty from -> level


def _counts(words: list[int], size: int) -> tuple[np.ndarray, dict[int, int]]:
    uni = np.bincount(words, minlength=size)
    keys, n = np.unique(np.asarray(words[:-1], np.int64) * size + np.asarray(words[1:], np.int64), return_counts=True)
    return uni, dict(zip(keys.tolist(), n.tolist(), strict=True))


def train(samples: list[tuple[str, int, str]]) -> Model:
    """Models of (language, level, text) rows."""
    texts = [(lang, level, _words(text)) for lang, level, text in samples]
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, _, ws in texts for w in ws}))}
    size = len(vocabulary) + 1
    classes = sorted({(lang, level) for lang, level, _ in texts})
    unis, bis = [], []
    for c in classes:
        uni, bi = np.zeros(size), {}
        for lang, level, ws in texts:
            if (lang, level) == c:
                u, b = _counts([vocabulary[w] for w in ws] or [0], size)
                uni += u
                for k, n in b.items():
                    bi[k] = bi.get(k, 0) + n
        unis.append(uni)
        bis.append(bi)
    pairs = np.array(sorted(set().union(*bis)), np.int64) if bis else np.zeros(0, np.int64)
    unigram, context, pair = np.zeros((size, len(classes))), np.zeros((size, len(classes))), np.zeros((len(pairs), len(classes)))
    for m, (uni, bi) in enumerate(zip(unis, bis, strict=True)):
        p = UNIGRAM * uni / max(1, uni.sum()) + (1 - UNIGRAM) / size
        unigram[:, m] = np.log(p)
        weight = np.where(uni > 0, BIGRAM, 0.0)
        context[:, m] = np.log(1 - weight)
        first, second = pairs // size, pairs % size
        seen = np.array([bi.get(k, 0) for k in pairs.tolist()], float)
        pair[:, m] = np.log(weight[first] * seen / np.maximum(1, uni[first]) + (1 - weight[first]) * p[second])
    f = np.float32
    return Model(vocabulary, unigram.astype(f), context.astype(f), pairs, pair.astype(f), np.array([c[1] for c in classes], f), [c[0] for c in classes])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: the non-decreasing step function nearest to y, as lower bounds and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest x, highest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    # between two blocks the bound lies in the middle
    bounds = [-np.inf] + [(p[3] + q[2]) / 2 for p, q in zip(blocks, blocks[1:], strict=False)]
    return bounds, [s / n for s, n, _, _ in blocks]


class Scorer:
    def __init__(self, model: Model):
        self.m = model

        @lru_cache(1 << 20)
        def known(token: str) -> tuple[int, bool]:
            w, running = word_of(token)
            return (model.vocabulary.get(w, 0) if w else -1), running

        self.known = known

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Difficulty (nan for a text without words), number of running words, and mean and deviation over windows of the
        surprisal under the nearest model, of each text."""
        m = self.m
        n = len(texts)
        lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        off = np.asarray(lists.offsets, np.int64)
        off = off - off[0]
        tokens = lists.flatten().dictionary_encode()
        rows = [self.known(t) for t in tokens.dictionary.to_pylist()]
        code = np.array([r[0] for r in rows] or [0], np.int64)[np.asarray(tokens.indices, np.int64)]
        running = np.array([r[1] for r in rows] or [False])[np.asarray(tokens.indices, np.int64)]
        total = np.concatenate([[0], np.cumsum(running)])
        words = total[off[1:]] - total[off[:-1]]
        doc = np.repeat(np.arange(n), np.diff(off))
        keep = code >= 0
        code, doc = code[keep], doc[keep]
        if not len(code):
            return np.full(n, np.nan), words, np.full((n, 2), np.nan)
        nth = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
        window = (np.diff(doc, prepend=doc[0]) != 0) | (nth % WINDOW == 0)
        window[0] = True
        start = np.flatnonzero(window)
        size = m.unigram.shape[0]
        before = np.where(np.diff(doc, prepend=-1) == 0, np.concatenate([[0], code[:-1]]), 0)
        key = before * size + code
        at = np.minimum(np.searchsorted(m.pairs, key), max(0, len(m.pairs) - 1))
        hit = (m.pairs[at] == key) if len(m.pairs) else np.zeros(len(key), bool)
        sums = np.empty((len(start), m.unigram.shape[1]), np.float64)
        step = 1 << 15  # windows at a time
        ends = np.append(start, len(code))
        for a in range(0, len(start), step):
            b = min(len(start), a + step)
            lo, hi = ends[a], ends[b]
            v = m.unigram[code[lo:hi]] + m.context[before[lo:hi]]
            h = hit[lo:hi]
            v[h] = m.pair[at[lo:hi][h]]
            sums[a:b] = np.add.reduceat(v, start[a:b] - lo, axis=0)
        length = np.diff(ends)
        owner = doc[start]
        read, at = np.unique(owner, return_index=True)
        total = np.add.reduceat(length, at)
        mean = -np.add.reduceat(sums, at, axis=0) / total[:, None]
        near = mean.argmin(axis=1)
        own = np.repeat(near, np.diff(np.append(at, len(start))))
        each = -sums[np.arange(len(start)), own] / length
        centre = mean[np.arange(len(read)), near]
        spread = np.sqrt(np.maximum(0, np.add.reduceat(each**2 * length, at) / total - centre**2))
        out, about = np.full(n, np.nan), np.full((n, 2), np.nan)
        out[read] = self.difficulty(mean, near)
        about[read] = np.stack([centre, spread], axis=1)
        return out, words, about

    def difficulty(self, mean: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Lowest level, plus for each step to the next one how far the text is beyond it, of mean surprisals (texts,
        models) and the nearest models."""
        languages = np.array(self.m.languages)
        out = np.zeros(len(mean))
        for language in set(self.m.languages):
            of = languages[near] == language
            cols = np.flatnonzero(languages == language)
            cols = cols[np.argsort(self.m.levels[cols], kind="stable")]
            x, levels = mean[of][:, cols], self.m.levels[cols]
            d = np.full(len(x), float(levels[0]))
            for k in range(1, len(cols)):
                gain = x[:, :k].min(axis=1) - x[:, k:].min(axis=1)
                d += (levels[k] - levels[k - 1]) / (1 + np.exp(-SHARPNESS * gain))
            out[of] = d
        return out

    def level(self, difficulty: np.ndarray) -> np.ndarray:
        """The level on the scale of the samples."""
        bounds, values = self.m.steps
        at = np.searchsorted(np.asarray(bounds), np.nan_to_num(difficulty), side="right") - 1
        return np.rint(np.asarray(values)[np.maximum(at, 0)]).astype(np.int32)


def fit(samples: list[tuple[str, int, str]], folds: int = 8) -> Model:
    """Trains on all samples; the isotonic map comes from difficulties of held-out samples."""
    samples = sorted((lang, level, text) for lang, level, text in samples if lang and level is not None and text)
    if not samples:
        raise ValueError("no samples of known level")
    x, y = [], []
    for k in range(folds):
        held = [s for i, s in enumerate(samples) if i % folds == k]
        rest = [s for i, s in enumerate(samples) if i % folds != k]
        if held and rest:
            d, _, _ = Scorer(train(rest)).batch(pa.array([t for _, _, t in held]))
            x += d.tolist()
            y += [float(level) for _, level, _ in held]
    model = train(samples)
    x, y = np.array(x), np.array(y)
    ok = ~np.isnan(x)
    model.steps = isotonic(x[ok], y[ok])
    return model


def level(spark: SparkSession, text: Column, samples: DataFrame, max_samples: int = 20_000) -> Column:
    """Struct column (level int 1.., difficulty, surprisal, spread double, words int) of a text column; all but words are
    null for texts of fewer than MIN_WORDS running words. A text is read once, also where a filter uses the result. The models are fitted on at most max_samples rows of (lang, level,
    text) samples; the table here has 128."""
    rows = samples.select("lang", "level", "text").where("lang is not null and level is not null and text is not null").limit(max_samples).collect()
    model = spark.sparkContext.broadcast(fit([(r.lang, r.level, r.text) for r in rows]))
    kind = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("difficulty", T.DoubleType()), T.StructField("surprisal", T.DoubleType()), T.StructField("spread", T.DoubleType()), T.StructField("words", T.IntegerType())])

    @F.arrow_udf(kind)
    def read(texts: pa.Array) -> pa.Array:
        scorer = _scorer(model)
        # slices of some megabytes of text, so that memory does not follow the batch
        parts = [scorer.batch(t) for t in slices(texts, 8 << 20)] or [scorer.batch(texts)]
        d, words, about = (np.concatenate(x) for x in zip(*parts, strict=True))
        none = (words < MIN_WORDS) | np.isnan(d)
        return pa.StructArray.from_arrays([pa.array(scorer.level(d), mask=none), pa.array(d, mask=none), *[pa.array(about[:, k], mask=none) for k in (0, 1)], pa.array(words.astype(np.int32))], names=["level", "difficulty", "surprisal", "spread", "words"])

    return read.asNondeterministic()(text)  # or a filter on the result would run it once more


_SCORER: dict[int, Scorer] = {}


def _scorer(model) -> Scorer:
    key = id(model.value)
    if key not in _SCORER:
        _SCORER.clear()
        _SCORER[key] = Scorer(model.value)
    return _SCORER[key]
