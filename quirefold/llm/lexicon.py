"""Minimal acyclic transducers from words to lists of ids.

The automaton is the minimal one of the sorted words (equal suffixes share their states); every arc carries how many words
precede it, so a walk adds up to the word's rank, and the rank addresses the word's ids. All of it is flat integer arrays that
are written to one file and memory-mapped by every worker of a machine.
"""

from __future__ import annotations

import json

import numpy as np


def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The arrays of the transducer of words, which may be empty."""
    order = sorted(words)
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs_of: list[tuple] = []
    count: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            arcs_of.append(key[1])
            count.append(node[0] + sum(count[t] for _, t in key[1]))
        return register[key]

    # the path of the last word, each node [final, [(label, state), ...]] with its last arc still open
    path: list[list] = [[False, []]]
    last = b""
    for w in order:
        k = 0
        while k < len(last) and k < len(w) and last[k] == w[k]:
            k += 1
        for i in range(len(last), k, -1):
            path[i - 1][1].append((last[i - 1], freeze(path.pop())))
        path += [[False, []] for _ in range(len(w) - k)]
        path[-1][0] = True
        last = w
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], freeze(path.pop())))
    root = freeze(path[0])
    keys, target, skip = [], [], []
    for s, arcs in enumerate(arcs_of):
        before = int(finals[s])
        for label, t in arcs:
            keys.append(s * 256 + label)
            target.append(t)
            skip.append(before)
            before += count[t]
    ids = [words[w] for w in order]
    return {
        "keys": np.array(keys, np.int64),
        "target": np.array(target, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array(finals, np.uint8),
        "starts": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.int32),
        "root": np.array([root], np.int64),
    }


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a line of JSON with the places of the arrays, then the arrays, each at a multiple of 64 bytes."""
    places, at = {}, 0
    for k, a in arrays.items():
        places[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 64))


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        raw = np.memmap(path, np.uint8, "r", offset=0)
        for k, (kind, n, at) in json.loads(head).items():
            b = len(head) + at
            setattr(self, k, raw[b : b + n * np.dtype(kind).itemsize].view(kind))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is not in the lexicon; all words walk at once."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n:
            return out
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(size) - size
        alive, state, rank = np.arange(n), np.full(n, int(self.root[0]), np.int64), np.zeros(n, np.int64)
        step = 0
        while len(alive):
            ended = size[alive] == step
            done = alive[ended]
            out[done] = np.where(self.final[state[ended]] == 1, rank[ended], -1)
            alive, state, rank = alive[~ended], state[~ended], rank[~ended]
            if not len(alive):
                break
            if not len(self.keys):  # a lexicon of no word, or of the empty one
                break
            key = state * 256 + flat[at[alive] + step]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            i = i[ok]
            alive, state, rank = alive[ok], self.target[i].astype(np.int64), rank[ok] + self.skip[i]
            step += 1
        return out

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.starts[rank] : self.starts[rank + 1]]
