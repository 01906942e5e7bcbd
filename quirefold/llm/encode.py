"""Encoding of a whole corpus with a public byte-level BPE (problem 8).

Method: minimal acyclic transducer lexicon. The words of all texts are counted (map-side combined), the frequent ones are
compiled with their ids into a transducer, which executors fetch once and all their workers memory-map; every other word is
merged exactly. Texts are cut into words by the tokenizer's own pattern, so the ids are the tokenizer's.
"""

from __future__ import annotations

import base64
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import lexicon
from quirefold.session import share_file

#: Where the vocabulary files of public tokenizers lie on the driver; executors fetch what they need.
TOKENIZERS = os.environ.get("QUIREFOLD_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: how the byte-level vocabulary of 50k cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most words in the lexicon, whatever the corpus: some megabytes on the driver and in the mapped file.
MAX_WORDS = 60_000
#: Words a task remembers before it starts anew.
CACHE = 400_000


@lru_cache(4)
def merger(tokenizers: str, name: str = VOCABULARY):
    """The exact encoder of the vocabulary, built once a process."""
    import tiktoken

    with open(f"{tokenizers}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts of a one-column table, words in bytes."""
    cut = regex.compile(PATTERN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out() -> pa.RecordBatch:
            w = list(c)
            return pa.RecordBatch.from_arrays([pa.array([x.encode() for x in w], pa.binary()), pa.array([c[x] for x in w], pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    c.update(cut.findall(t.as_py()))
                if len(c) > CACHE:
                    yield out()
                    c = Counter()
        if c:
            yield out()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, tokenizers: str = TOKENIZERS, max_words: int = MAX_WORDS) -> str:
    """Count, compile and ship the lexicon of the max_words most frequent words; the name under which executors have it."""
    spark = texts.sparkSession
    top = count_words(texts).where((F.col("n") > 1) & (F.length("word") <= 64)).orderBy(F.desc("n"), "word").limit(max_words).select("word").collect()
    enc = merger(tokenizers)
    spark.sparkContext.addFile(f"{tokenizers}/{VOCABULARY}.tiktoken")
    words = {bytes(r["word"]): enc.encode_ordinary(bytes(r["word"]).decode()) for r in top}
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    with tempfile.TemporaryDirectory() as d:
        lexicon.save(lexicon.build(words), os.path.join(d, name))
        return share_file(spark, os.path.join(d, name))


@lru_cache(2)
def _mapped(name: str) -> lexicon.Lexicon:
    return lexicon.Lexicon(SparkFiles.get(name))


class Encoder:
    """Texts to ids, in one task: words seen before by a table of slots, new ones by the transducer, unseen ones by merging."""

    def __init__(self, lex: lexicon.Lexicon, tokenizers: str):
        self.lex, self.merge, self.find = lex, merger(tokenizers), regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        new: list[str] = []

        class Slots(dict):
            def __missing__(self, w: str) -> int:
                new.append(w)
                self[w] = n = len(self)
                return n

        self.slots, self.new = Slots(), new
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self) -> None:
        """Ids of the new words."""
        if not self.new:
            return
        words = [w.encode() for w in self.new]
        ranks = self.lex.ranks(words)
        parts = [self.lex.ids_of(r) if r >= 0 else np.array(self.merge.encode_ordinary(w), np.int32) for r, w in zip(ranks.tolist(), self.new)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *parts]).astype(np.int32)
        self.new.clear()

    def slots_of(self, text: str) -> np.ndarray:
        words = self.find(text)
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if len(self.slots) > CACHE:
            self.forget()
        each = [self.slots_of(t) if t else np.zeros(0, np.int64) for t in texts]
        self.learn()
        slot = np.concatenate(each) if each else np.zeros(0, np.int64)
        size = self.sizes[slot] if len(slot) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        n = np.fromiter(map(len, each), np.int64, len(each))
        ends = np.cumsum(n)
        index = np.repeat(self.starts[slot] - total[:-1], size) + np.arange(total[-1]) if len(slot) else np.zeros(0, np.int64)
        return self.flat[index], total[ends] - total[ends - n]


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, max_words: int = MAX_WORDS) -> DataFrame:
    """(key, ids array<int>) of every row. Null and empty texts give an empty list; special tokens' strings in a text are text.
    Repeated rows give repeated rows, other columns are not read, an empty table gives none; texts are never cut."""
    docs = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    name = build_lexicon(docs.select("text"), tokenizers, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(_mapped(name), SparkFiles.getRootDirectory())
        for b in batches:
            for part in pieces(b):
                ids, n = e.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return docs.mapInArrow(run, f"{key} long, ids array<int>")


def pieces(b: pa.RecordBatch, bytes_each: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some megabytes of text, at least a row each."""
    size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(1)]) if b.num_rows else np.zeros(0)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + bytes_each, "right")))
        yield b.slice(at, to - at)
        at = to


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, max_words: int = MAX_WORDS) -> DataFrame:
    """(key, n_tokens) of every row: as encode_corpus, without writing the ids down."""
    docs = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    name = build_lexicon(docs.select("text"), tokenizers, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(_mapped(name), SparkFiles.getRootDirectory())
        for b in batches:
            for part in pieces(b):
                _, n = e.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return docs.mapInArrow(run, f"{key} long, n_tokens long")
