"""Trains the tagger of personal data: python -m tendril.llm.pii_train [steps [seed [workers]]]. Writes models/pii.npz.

Training is a function of steps, seed and workers: in every step each worker takes the gradient of a batch of its own,
drawn from a generator that these numbers seed, and their mean is applied. The weights of the package are those of
STEPS, SEED and WORKERS below.
"""

from __future__ import annotations

import multiprocessing as mp
import random
import sys
import time
from pathlib import Path

import numpy as np

from tendril.llm import pii_model as M
from tendril.llm.pii_corpus import Maker

PATH = Path(__file__).parent / "models" / "pii.npz"
STEPS, SEED, WORKERS = 5500, 1, 8
HIDDEN, BATCH, ROUND = 64, 40, 12


def batch_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded (T, B) ids, mask and tags of labelled texts."""
    some = [(M.encode(t[: 3 * M.WINDOW]), M.tags_of(len(t), s)[: 3 * M.WINDOW]) for t, s in texts]
    steps = max(len(c) for c, _ in some)
    ids, tags, mask = np.zeros((steps, len(some)), np.int64), np.zeros((steps, len(some)), np.int64), np.zeros((steps, len(some)), bool)
    for b, (c, t) in enumerate(some):
        ids[: len(c), b], tags[: len(c), b], mask[: len(c), b] = c, t, True
    return ids, mask, tags


def _work(pipe, seed: int, worker: int) -> None:
    """Serves gradients: texts of ROUND steps are drawn at once and batched by length, in an order all workers share."""
    step, pool = 0, []
    while (p := pipe.recv()) is not None:
        at = step % ROUND
        if at == 0:
            maker = Maker(f"{seed} {worker} {step}")
            pool = sorted((maker.write() for _ in range(BATCH * ROUND)), key=lambda x: len(x[0]))
            order = random.Random(f"{seed} {step}").sample(range(ROUND), ROUND)
        k = order[at]
        pipe.send(M.loss_and_grads(p, *batch_of(pool[k * BATCH : (k + 1) * BATCH])))
        step += 1


def score(p: dict, seed: int = 99, n: int = 3000) -> dict[str, float]:
    """F1 of whole spans by kind on texts of another seed."""
    maker = Maker(seed)
    rows = [maker.write() for _ in range(n)]
    found = M.tag(p, [t for t, _ in rows])
    out = {}
    for kind in (*M.KINDS, None):
        a = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans if kind in (None, s[2])}
        b = {(i, *s) for i, spans in enumerate(found) for s in spans if kind in (None, s[2])}
        out[kind or "ALL"] = round(2 * len(a & b) / max(1, len(a) + len(b)), 4)
    return out


def train(steps: int = STEPS, seed: int = SEED, workers: int = WORKERS) -> dict:
    pipes, spawn = [], mp.get_context("spawn")
    for w in range(workers):
        mine, theirs = spawn.Pipe()
        spawn.Process(target=_work, args=(theirs, seed, w), daemon=True).start()
        pipes.append(mine)
    p = M.init(HIDDEN)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    mean, began = 1.0, time.time()
    for step in range(1, steps + 1):
        for pipe in pipes:
            pipe.send(p)
        got = [pipe.recv() for pipe in pipes]
        g = {k: sum(x[1][k] for x in got) / workers for k in p}
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        rate = 6e-3 * min(1, step / 100) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.01)
        for k in p:
            d = g[k] * scale
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] = p[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        mean = 0.98 * mean + 0.02 * sum(x[0] for x in got) / workers
        if step % 200 == 0:
            print(step, round(mean, 5), round(time.time() - began), flush=True)
    for pipe in pipes:
        pipe.send(None)
    return p


if __name__ == "__main__":
    weights = train(*map(int, sys.argv[1:]))
    PATH.parent.mkdir(exist_ok=True)
    np.savez_compressed(PATH, **{k: x.astype(np.float16) for k, x in weights.items()})
    print(score(M.load(str(PATH))))
