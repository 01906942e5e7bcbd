"""A character tagger in numpy: bidirectional LSTM with CRF transitions.

Characters are mapped to some hundred classes whose weights go straight into the gates (an embedding folded into the input
weights). Long streams are cut into overlapping windows; each character's emissions come from the window in which it lies
further inside, and the best path is then sought over the stream as a whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Tags: nothing, and one for each kind of item.
TAGS = ("-", "email", "phone", "identity_number", "street_address", "name")
K = len(TAGS)
WINDOW, STRIDE = 256, 224
#: Classes beyond those of printable ASCII.
_NL, _SPACE, _UPPER, _LOWER, _DIGIT, _OTHER, _GAP = range(95, 102)
CLASSES = 102
#: Gaps before and behind a text.
EDGE = 4
#: Characters around a hot one that the decoder looks at.
JOIN = 16
#: Stretches that are decoded side by side.
SIDE = 4096
#: Windows of one step; bounds the memory to some tens of MB.
ROWS = 1024


@lru_cache(1)
def _table() -> np.ndarray:
    t = np.full(65536, _OTHER, np.uint8)
    for c in range(0xD800):
        x = chr(c)
        if 32 <= c < 127:
            t[c] = c - 32
        elif x in "\r\n":
            t[c] = _NL
        elif x.isspace():
            t[c] = _SPACE
        elif x.isupper():
            t[c] = _UPPER
        elif x.islower() or unicodedata.category(x) == "Mn":
            t[c] = _LOWER
        elif x.isdigit():
            t[c] = _DIGIT
    t[0] = _GAP
    return t


def classes_of(s: str) -> np.ndarray:
    """The class of each code point."""
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table()[np.minimum(c, 65535)]


def _direction(x: np.ndarray, live: np.ndarray, w: dict, d: str, emit: np.ndarray) -> None:
    """Adds one direction's emissions of windows x (T, N) to emit (T, N, K). Windows are sorted longest first: at step t the first
    live[t] of them have a character left, so no window's result depends on the others' lengths."""
    e, u, out = w[f"E{d}"], w[f"U{d}"], w[f"O{d}"]
    hid = u.shape[-1]
    n = x.shape[1]
    h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    g, r = np.empty((4, n, hid), np.float32), np.empty((4, n, hid), np.float32)  # gate by gate, so that each lies in one piece
    told = np.empty((n, out.shape[1]), np.float32)
    m = n
    for t in range(len(x)):
        if live[t] != m:
            m = int(live[t])
            h, c, g, r, told = h[:m], c[:m], g[:, :m], r[:, :m], told[:m]
        at = x[t, :m].astype(np.intp)
        for k in range(4):
            e[k].take(at, 0, g[k], "clip")  # no class is beyond the table; clip spares a copy
        np.matmul(h, u, out=r)
        g += r
        np.tanh(g, out=g)  # gates are sigmoids by way of tanh: their weights are halved in advance
        g[:3] += 1  # twice the gates
        c *= g[0]
        g[1] *= g[3]
        c += g[1]
        c *= 0.5
        np.tanh(c, out=h)
        h *= g[2]  # twice the state: what it meets is halved in advance
        np.matmul(h, out, out=told)
        emit[t, :m] += told


def halved(w: dict) -> dict:
    """Weights for _direction: gate by gate, those of the three gates halved, and all that the state meets. Halves and doubles are
    exact, so nothing is rounded otherwise than in the plain form."""
    w = dict(w)
    for d in "fb":
        hid = w[f"U{d}"].shape[0]
        scale = np.ones(4 * hid, np.float32)
        scale[: 3 * hid] = 0.5
        gates = lambda m: np.ascontiguousarray(m.reshape(-1, 4, hid).transpose(1, 0, 2))
        w[f"E{d}"] = gates((w[f"E{d}"] + w[f"B{d}"]) * scale)
        w[f"U{d}"] = gates(w[f"U{d}"] * scale * np.float32(0.5))
        w[f"O{d}"] = w[f"O{d}"] * np.float32(0.5)
    return w


def emissions(texts: list[np.ndarray], w: dict) -> list[np.ndarray]:
    """(n, K) of each of several streams of classes. A window lies in one stream, with EDGE gaps before and behind the stream as in
    training; a character's emissions come from the window in which it lies further inside."""
    gap = np.full(EDGE, _GAP, np.uint8)
    size = np.array([len(x) + 2 * EDGE for x in texts], np.int64)
    flat = np.concatenate([z for x in texts for z in (gap, x, gap)]) if texts else np.zeros(0, np.uint8)
    base = np.cumsum(size) - size
    # windows of each stream: each but the first begins STRIDE behind the one before
    count = -(-np.maximum(1, size - (WINDOW - STRIDE)) // STRIDE)
    starts = np.repeat(base, count) + STRIDE * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    ends = np.minimum(starts + WINDOW, np.repeat(base + size, count))
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    out = np.empty((len(flat), K), np.float32)
    half = (WINDOW - STRIDE) // 2
    opens = np.isin(starts, base)
    closes = np.isin(ends, base + size)
    for at in range(0, len(order), ROWS):
        o = order[at : at + ROWS]
        n, T = length[o], int(length[o[0]])
        step = np.arange(T)[:, None]
        live = (n[None, :] > step).sum(1)
        wide = len(o) + 3  # no power of two between the steps, else their rows share a few lines of the cache
        emit = np.zeros((T, wide, K), np.float32)
        _direction(flat.take(starts[o] + step, mode="clip"), live, w, "f", emit)  # what lies behind a window's end is not looked at
        back = np.zeros((T, wide, K), np.float32)
        _direction(flat.take(ends[o] - 1 - step, mode="clip"), live, w, "b", back)
        # of each window the part that no other holds further inside
        lo, hi = np.where(opens[o], 0, half), np.where(closes[o], n, half + STRIDE)
        size_of, at_of = hi - lo, np.cumsum(hi - lo) - (hi - lo)
        row, cell = np.arange(len(o)), np.arange(0, int(size_of.sum()) * wide, wide)
        part = emit.reshape(-1, K).take(cell + np.repeat(row + (lo - at_of) * wide, size_of), 0)
        part += back.reshape(-1, K).take(np.repeat(row + (n - 1 - lo + at_of) * wide, size_of) - cell, 0)
        for a, z, m in zip(at_of.tolist(), (starts[o] + lo).tolist(), size_of.tolist()):
            out[z : z + m] = part[a : a + m]
    out += w["b"]
    return [out[b + EDGE : b + n - EDGE] for b, n in zip(base, size)]


def best_paths(each: list[np.ndarray], trans: np.ndarray, lead: float = 0.0) -> list[np.ndarray]:
    """best_path of several streams at once; between them lies more nothing than a stretch reaches over."""
    ends = np.cumsum([len(e) + 2 * JOIN + 2 for e in each], dtype=np.int64).tolist()
    flat = np.full((K, ends[-1] if each else 0), -1e6, np.float32)
    flat[0] = 0
    spans = [(z - len(e) - 2 * JOIN - 2, z - 2 * JOIN - 2) for e, z in zip(each, ends)]
    for e, (a, b) in zip(each, spans):  # turned text by text, which the cache holds
        flat[:, a:b] = e.T
    tags = _best_path(flat, trans, lead)
    return [tags[a:b] for a, b in spans]


def best_path(e: np.ndarray, trans: np.ndarray, lead: float = 0.0) -> np.ndarray:
    """The tags of the best path over the whole stream. lead is added to every item tag, for recall.

    Items of different kinds never touch: from an item tag the path goes on with it or with nothing.
    Where no item tag can gain anything (its emission and its own transition are below nothing's), the best path is nothing;
    so it is sought only over the stretches in between, all at once.
    """
    return _best_path(np.ascontiguousarray(e.T), trans, lead)


def _best_path(e: np.ndarray, trans: np.ndarray, lead: float) -> np.ndarray:
    """best_path of emissions (K, n)."""
    tags = np.zeros(e.shape[1], np.int8)
    hot = np.zeros(len(tags), bool)
    for k in range(1, K):
        gain = e[k] - e[0]
        gain += lead
        gain += max(np.float32(0), trans[k, k] - trans[0, 0])
        hot |= gain > 0
    if not hot.any():
        return tags
    # stretches: hot characters with less than twice JOIN between them, widened by as much
    at = np.flatnonzero(hot)
    cuts = np.flatnonzero(np.diff(at) > 2 * JOIN)
    first, last = np.maximum(at[np.concatenate([[0], cuts + 1])] - JOIN, 0), np.minimum(at[np.concatenate([cuts, [len(at) - 1]])] + JOIN + 1, len(tags))
    size = last - first
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    own, into, out, still = np.diag(trans)[1:, None], trans[0, 1:, None], trans[1:, 0, None], trans[0, 0]
    kinds, falling = np.arange(1, K, dtype=np.int8)[:, None], np.arange(K - 1, 0, -1, dtype=np.int8)[:, None]
    for i in range(0, len(size), SIDE):
        f, n = first[i : i + SIDE], size[i : i + SIDE]
        # step t goes over the first live[t] stretches, the longest; what they hold of it lies from base[t] on
        live = len(n) - np.cumsum(np.bincount(n))[: n[0]]
        base = np.cumsum(live) - live
        prev = np.empty(K * int(n.sum()), np.int8)  # the tag that best precedes each tag
        nothing = np.zeros(len(n), np.float32)
        item = np.full((K - 1, len(n)), -1e9, np.float32)
        for t, (m, z) in enumerate(zip(live.tolist(), base.tolist())):
            old, now, came = nothing[:m], item[:, :m], prev[K * z : K * (z + m)].reshape(K, m)
            x = e.take(f[:m] + t, 1, mode="clip")
            leave, enter = now + out, old + into
            now += own
            np.multiply(now >= enter, kinds, out=came[1:])  # an item tag is preceded by itself or by nothing
            np.maximum(now, enter, out=now)
            now += x[1:]
            now += lead
            most = leave.max(0)
            old += still
            ((leave == most) * falling).max(0, out=came[0])  # nothing by nothing or, of equals, by the first kind
            np.subtract(K, came[0], out=came[0])
            came[0] *= most > old
            np.maximum(old, most, out=old)
            old += x[0]
        tag = np.where(nothing + still >= (item + out).max(0), 0, (item + out).argmax(0) + 1)
        rows = np.arange(len(n))
        for m, z, t in zip(live[::-1].tolist(), base[::-1].tolist(), range(len(live) - 1, -1, -1)):
            now = tag[:m]
            tags[f[:m] + t] = now
            now *= m
            now += rows[:m]
            now[:] = prev[K * z : K * (z + m)].take(now)
    return tags


def runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, tag) of the runs of item tags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    edges = edge.tolist()
    return [(a, b, int(tags[a])) for a, b in zip(edges, edges[1:]) if tags[a] != 0] if edges else []
