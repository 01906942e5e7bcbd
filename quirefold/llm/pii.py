"""Personal information inside free text (problem 10).

Method: a character-level bidirectional LSTM with CRF transitions (tagger.py), trained in numpy from labelled spans
(pii_train.py). It reads every text whole, in overlapping windows of that text alone, whose emissions are reconciled and decoded
as one best path; what the path marks is what is found, of the kind that it says. Shapes (pii_rules.py) only trim the edges.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import pii_rules, tagger

#: The trained weights; python -m quirefold.llm.pii_train makes them anew.
MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
#: Added to item tags when decoding: more finds more, and more that is none.
LEAD = 0.0
#: Characters of texts that are tagged side by side.
CHARS = 2 << 20
#: The placeholder of each kind.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "name": "[NAME]"}


@lru_cache(2)
def weights(path: str = MODEL) -> dict:
    with np.load(path) as z:
        w = {k: z[k] for k in z.files}
    return tagger.halved(w)


def find(texts: list[str | None], w: dict, lead: float = LEAD) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the items of each text, in code points; what else is in the list makes no difference."""
    out: list[list] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        parts, size, to = [], 0, at
        while to < len(texts) and (not parts or size < CHARS):  # texts are never cut; a long one is tagged alone
            if texts[to]:
                parts.append((to, *pii_rules.shadow(texts[to])))
                size += len(texts[to])
            to += 1
        if parts:
            e = tagger.emissions([tagger.classes_of(s) for _, s, _ in parts], w)
            for (n, s, place), tags in zip(parts, tagger.best_paths(e, w["trans"], lead)):
                got = pii_rules.items_of(s, [(a, b, tagger.TAGS[t]) for a, b, t in tagger.runs(tags)])
                out[n] = [(int(place[a]), int(place[b - 1]) + 1, kind) for a, b, kind in got] if place is not None else got
        at = to
    return out


def find_pii(documents: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, kind, start_at) of every email, phone, identity number, street address and name.

    Null and empty texts have none; texts of any length are read whole; start_at counts code points. Repeated rows give repeated
    rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights(model)
        for b in batches:
            rows = [(i, k, a) for i, items in zip(b.column(0).to_pylist(), find(b.column(1).to_pylist(), w)) for a, _, k in items]
            c = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int32())], names=[key, "kind", "start_at"])

    return documents.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, kind string, start_at int")


def redact(t: str | None, items: list[tuple[int, int, str]]) -> str | None:
    if t is None:
        return None
    out, at = [], 0
    for a, b, k in items:
        if a >= at:
            out += [t[at:a], PLACEHOLDERS[k]]
            at = b
    return "".join([*out, t[at:]])


def redact_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_items, redacted): each text with a typed placeholder for each item and otherwise unchanged; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            items = find(texts, w)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in items], pa.int32()), pa.array([redact(t, x) for t, x in zip(texts, items)], pa.string())], names=[key, "n_items", "redacted"])

    return documents.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, n_items int, redacted string")
