"""Character BiLSTM with a CRF on top, in numpy: forward, gradients, training and decoding."""

from __future__ import annotations

import numpy as np

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON_NAME")
#: Tag 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
CHARS = "".join(map(chr, range(32, 127))) + "\n„”“–—’§°€ĄĆĘŁŃÓŚŹŻąćęłńóśźżÄÖÜäöüßÀÂÇÉÈÊËÎÏÔÙÛàâçéèêëîïôùûÁÍÚÑáíúñčďěňřšťůýžČŘŠŽ"
_ID = {c: i + 5 for i, c in enumerate(CHARS)}
VOCAB = len(CHARS) + 5


def char_id(c: str) -> int:
    """1 to 4 stand for characters outside CHARS by class; 0 pads."""
    return _ID.get(c) or (1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4)


_TABLE = np.fromiter((char_id(chr(i)) if not 0xD800 <= i < 0xE000 else 4 for i in range(0x2200)), np.uint8)


def encode(text: str) -> np.ndarray:
    """Character classes of a text, one for each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x2200, _TABLE[np.minimum(codes, 0x21FF)], 4).astype(np.uint8)


def allowed() -> np.ndarray:
    """Which tag may follow which; the last row is the start."""
    ok = np.ones((TAGS + 1, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


FORBID = np.where(allowed(), 0.0, -1e4).astype(np.float32)


def init(hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["x" + d] = r.normal(0, 0.3, (VOCAB, 4 * hidden))
        p["x" + d][:, hidden : 2 * hidden] += 1.0
        p["h" + d] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
    p["o"] = r.normal(0, 0.1, (2 * hidden, TAGS))
    p["ob"] = np.zeros(TAGS)
    p["t"] = np.zeros((TAGS + 1, TAGS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    np.multiply(z, 0.5, out=z)
    np.tanh(z, out=z)
    z += 1
    z *= 0.5
    return z


def _lstm(table, wh, ids, mask, back: bool, keep: bool):
    """States of one direction over ids (T, B). Padding keeps the state as it is."""
    steps, batch = ids.shape
    n = wh.shape[0]
    h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    out = np.empty((steps, batch, n), np.float32)
    saved = [None] * steps
    for t in range(steps - 1, -1, -1) if back else range(steps):
        z = h @ wh
        z += table[ids[t]]
        a = _sigmoid(z[:, : 3 * n])
        i, f, o, g = a[:, :n], a[:, n : 2 * n], a[:, 2 * n :], np.tanh(z[:, 3 * n :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        m = mask[t][:, None]
        if keep:
            saved[t] = (h, c, i, f, o, g, tc)
        if m.all():
            c, h = c2, h2
        else:
            c, h = np.where(m, c2, c), np.where(m, h2, h)
        out[t] = h
    return out, saved


def _lstm_back(wh, ids, mask, saved, grad, back: bool):
    steps, batch = ids.shape
    n = wh.shape[0]
    dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    dz_all = np.empty((steps, batch, 4 * n), np.float32)
    dwh = np.zeros_like(wh)
    for t in range(steps) if back else range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = saved[t]
        m = mask[t][:, None].astype(np.float32)
        d = dh + grad[t]
        dhm, dcm = d * m, dc * m
        dc2 = dcm + dhm * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :n] = dc2 * g * i * (1 - i)
        dz[:, n : 2 * n] = dc2 * c * f * (1 - f)
        dz[:, 2 * n : 3 * n] = dhm * tc * o * (1 - o)
        dz[:, 3 * n :] = dc2 * i * (1 - g * g)
        dwh += h.T @ dz
        dh = dz @ wh.T + d * (1 - m)
        dc = dc2 * f + dc * (1 - m)
    flat = ids.reshape(-1)
    hot = np.zeros((VOCAB, flat.size), np.float32)
    hot[flat, np.arange(flat.size)] = 1
    return hot @ dz_all.reshape(flat.size, -1), dwh


def emissions(p: dict, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Tag scores (T, B, TAGS) of padded ids (T, B)."""
    f, _ = _lstm(p["xf"], p["hf"], ids, mask, False, False)
    b, _ = _lstm(p["xb"], p["hb"], ids, mask, True, False)
    n = f.shape[2]
    return f @ p["o"][:n] + b @ p["o"][n:] + p["ob"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def loss_and_grads(p: dict, ids, mask, tags):
    """Mean negative log-likelihood of a character under the CRF, and the gradients."""
    f, sf = _lstm(p["xf"], p["hf"], ids, mask, False, True)
    b, sb = _lstm(p["xb"], p["hb"], ids, mask, True, True)
    n = f.shape[2]
    e = f @ p["o"][:n] + b @ p["o"][n:] + p["ob"]
    steps, batch, _ = e.shape
    trans = p["t"] + FORBID
    inner, start = trans[:-1], trans[-1]
    alpha = np.empty_like(e)
    alpha[0] = start + e[0]
    for t in range(1, steps):
        a = _lse(alpha[t - 1][:, :, None] + inner[None], 1) + e[t]
        alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
    logz = _lse(alpha[-1], 1)
    beta = np.zeros_like(e)
    ge, gt = np.zeros_like(e), np.zeros_like(p["t"])
    rows = np.arange(batch)
    score = start[tags[0]] + e[0, rows, tags[0]]
    for t in range(steps - 2, -1, -1):
        v = _lse(inner[None] + (beta[t + 1] + e[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None], v, beta[t + 1])
    for t in range(steps):
        m = mask[t][:, None].astype(np.float32)
        post = np.exp(alpha[t] + beta[t] - logz[:, None])
        post[rows, tags[t]] -= 1
        ge[t] = post * m
        if t == 0:
            gt[-1] += ge[0].sum(0)
        else:
            pair = np.exp(alpha[t - 1][:, :, None] + inner[None] + (e[t] + beta[t])[:, None, :] - logz[:, None, None]) * m[:, :, None]
            gt[:-1] += pair.sum(0)
            np.subtract.at(gt, (tags[t - 1], tags[t]), mask[t].astype(np.float32))
            score = score + np.where(mask[t], inner[tags[t - 1], tags[t]] + e[t, rows, tags[t]], 0)
    total = mask.sum()
    ge /= total
    gt /= total
    fl, bl, gl = f.reshape(-1, n), b.reshape(-1, n), ge.reshape(-1, TAGS)
    grads = {"o": np.concatenate([fl.T @ gl, bl.T @ gl]), "ob": gl.sum(0), "t": np.where(FORBID < 0, 0, gt)}
    grads["xf"], grads["hf"] = _lstm_back(p["hf"], ids, mask, sf, ge @ p["o"][:n].T, False)
    grads["xb"], grads["hb"] = _lstm_back(p["hb"], ids, mask, sb, ge @ p["o"][n:].T, True)
    return float((logz - score).sum() / total), grads


def viterbi(p: dict, e: np.ndarray) -> np.ndarray:
    """Best tag path for scores (T, B, TAGS); rows of padding may hold anything and are ignored by the caller."""
    trans = p["t"] + FORBID
    inner = trans[:-1]
    steps, batch, _ = e.shape
    at = np.empty((steps, batch, TAGS), np.uint8)
    v = trans[-1] + e[0]
    for t in range(1, steps):
        x = v[:, :, None] + inner[None]
        at[t] = x.argmax(1)
        v = x.max(1) + e[t]
    path = np.empty((steps, batch), np.uint8)
    path[-1] = v.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = at[t, rows, path[t]]
    return path


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a tag row."""
    out, on = [], np.flatnonzero(tags)
    i = 0
    while i < len(on):
        a = on[i]
        kind = (int(tags[a]) - 1) // 2
        b = a + 1
        while b < len(tags) and tags[b] == 2 + 2 * kind:
            b += 1
        out.append((int(a), int(b), KINDS[kind]))
        while i < len(on) and on[i] < b:
            i += 1
    return out


def tags_of(length: int, spans) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        tags[a] = 1 + 2 * k
        tags[a + 1 : b] = 2 + 2 * k
    return tags


#: Window of characters that is read at once, and what neighbouring windows share.
WINDOW, OVERLAP = 384, 96


def tag(p: dict, texts: list[str], batch_chars: int = 65536) -> list[list[tuple[int, int, str]]]:
    """Spans of each text. A text longer than WINDOW is read in overlapping windows; at each character the scores of
    the window in which it lies furthest from an edge count, and one path is then decoded over the whole text."""
    parts = []  # (text, offset, ids)
    codes = [encode(t) for t in texts]
    for k, c in enumerate(codes):
        if len(c):
            at = 0
            while True:
                parts.append((k, at, c[at : at + WINDOW]))
                if at + WINDOW >= len(c):
                    break
                at += WINDOW - OVERLAP
    parts.sort(key=lambda x: len(x[2]))
    out: list[list] = [[] for _ in texts]
    long: dict[int, dict[int, np.ndarray]] = {}
    i = 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and len(parts[j][2]) * (j - i + 1) <= batch_chars:
            j += 1
        some = parts[i:j]
        steps = len(some[-1][2])
        ids, mask = np.zeros((steps, j - i), np.int64), np.zeros((steps, j - i), bool)
        for b, (_, _, c) in enumerate(some):
            ids[: len(c), b] = c
            mask[: len(c), b] = True
        e = emissions(p, ids, mask)
        e[~mask] = 0
        e[~mask, 0] = 50
        path = viterbi(p, e)
        for b, (k, at, c) in enumerate(some):
            if len(codes[k]) > WINDOW:
                long.setdefault(k, {})[at] = e[: len(c), b].copy()
            elif path[: len(c), b].any():
                out[k] = spans_of(path[: len(c), b])
        i = j
    for k, windows in long.items():
        e = np.zeros((len(codes[k]), 1, TAGS), np.float32)
        for at, w in sorted(windows.items()):
            skip = OVERLAP // 2 if at else 0
            e[at + skip : at + len(w), 0] = w[skip:]
        out[k] = spans_of(viterbi(p, e)[:, 0])
    return out


def load(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}
