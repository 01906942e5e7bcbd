"""Markup residue (problem 3): structure of texts, clean text, and the site style tree.

The method named for this problem, the site style tree, tells which branches of a site's pages matter; it prunes what many pages
share, and so can't list every heading, item, code block and formula of every page. found_structure follows the plain rule (the
parsers of markup.py); prune_sites runs the method over the whole table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import norm_key
from quirefold.llm import markup
from quirefold.session import cut

KINDS = ("heading", "list_item", "code", "formula")
#: A content goes if its importance (0 for what every page has, 1 for what one has) is below this.
THRESHOLD = 0.35
#: A branch goes, with all below it, if its composite importance and that of all below it is below this.
BRANCH = 0.2
#: Weight of a branch's own styles against its children, by the number of its styles.
GAMMA = 0.9
#: Copies of each low-importance node in the join with blocks: the footer of a third of all pages is met by so many tasks.
SALTS = 32


def found_structure(documents: DataFrame, key: str = "doc_id", text: str = "content_text") -> DataFrame:
    """(doc_id, kind, kind_no, first_word) of every heading, list item, code block and displayed formula, in text order.

    Null, empty and blank texts have none. A block without letters or digits has the empty first_word. Repeated rows give
    repeated rows; other columns are not read; texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, nos, words = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if not t.is_valid:
                    continue
                n = dict.fromkeys(KINDS, 0)
                for x in markup.parse(t.as_py())[1]:
                    if x.kind in n:
                        n[x.kind] += 1
                        ids.append(i)
                        kinds.append(x.kind)
                        nos.append(n[x.kind])
                        words.append(markup.first_word(x.text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(nos, pa.int32()), pa.array(words, pa.string())], names=[key, "kind", "kind_no", "first_word"])

    return documents.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, kind string, kind_no int, first_word string")


def clean_texts(documents: DataFrame, key: str = "doc_id", text: str = "content_text") -> DataFrame:
    """(doc_id, markup, clean_text): text without markup that still shows headings, items, code and formulas; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [markup.parse(t) if t is not None else (None, None) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([None if g[1] is None else markup.render(g[1]) for g in got], pa.string())], names=[key, "markup", "clean_text"])

    return documents.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, markup string, clean_text string")


def _h(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_BLOCKS = "array<struct<kind:string,level:int,path:string,text:string,h:long>>"
_BLOCK_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("path", pa.string()), ("text", pa.string()), ("h", pa.int64())]))
_BRANCH_TYPE = pa.list_(pa.struct([("path", pa.string()), ("h", pa.int64())]))


def parsed_pages(docs: DataFrame) -> DataFrame:
    """(key, host, blocks, branches) of (key, host, text): each page's blocks with their branch and their content's hash, and each
    of its branches with the hash of its children's tags. Pages are parsed once. Null texts have null blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, branches = [], []
            for t in b.column(2).to_pylist():
                if t is None:
                    blocks.append(None), branches.append(None)
                    continue
                lang, found = markup.parse(t)
                kids: dict[str, list[str]] = {}
                for x in found:
                    parts = [lang, *x.path.split("/")]
                    for k in range(1, len(parts)):
                        up, tag = "/".join(parts[:k]), parts[k]
                        if not kids.setdefault(up, []) or kids[up][-1] != tag:  # a run of the same tag is one style
                            kids[up].append(tag)
                blocks.append([{"kind": x.kind, "level": x.level, "path": f"{lang}/{x.path}", "text": x.text, "h": _h(x.text)} for x in found])
                branches.append([{"path": up, "h": _h(",".join(tags))} for up, tags in kids.items()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blocks, _BLOCK_TYPE), pa.array(branches, _BRANCH_TYPE)], names=["key", "host", "blocks", "branches"])

    return docs.select("key", "host", "text").mapInArrow(run, f"key long, host string, blocks {_BLOCKS}, branches array<struct<path:string,h:long>>")


def _features(docs: DataFrame) -> DataFrame:
    return features_of(parsed_pages(docs))


def features_of(pages: DataFrame) -> DataFrame:
    """(key, host, path, leaf, h): once a page, every leaf with its content's hash, and every branch with its children's."""
    leaf = F.array_distinct(F.transform("blocks", lambda x: F.struct(x["path"], F.lit(True).alias("leaf"), x["h"])))
    branch = F.transform("branches", lambda x: F.struct(x["path"], F.lit(False).alias("leaf"), x["h"]))
    return pages.where("blocks IS NOT NULL").select("key", "host", F.inline(F.concat(leaf, branch)))


def _ancestors(nodes: DataFrame) -> DataFrame:
    """nodes with a row for each of the branches they lie in (up) and how far above it is (far)."""
    parts = F.split("path", "/")
    n = F.size(parts) - 1
    ups = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct((n - k + 1).alias("far"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))
    return nodes.where(n > 0).select("*", F.inline(ups))


def style_tree(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree of each host: nodes (host, path, leaf, pages, styles, importance) and styles or contents (host, path, leaf, h,
    n, importance).

    The pages of a host are laid over each other by path. An even spread of a content over n of m pages has entropy log n / log m,
    so its importance is one minus that, and a leaf's is the mean over its blocks. A branch's own importance is the entropy of its
    presentation styles over its pages; its composite importance weighs that against the mean of its children's composite importance, the more
    styles it has the more: (1 - GAMMA^styles) * own + GAMMA^styles * children, from the leaves up. Resolved for all branches at
    once: what a node adds to a branch above it is its own part times the factors in between."""
    parts = features.groupBy("host", "path", "leaf", "h").agg(F.count("*").alias("n"))
    pages = features.where("leaf").select("host", "path", "key").distinct().groupBy("host", "path").agg(F.count("*").alias("m"))
    branch = features.where("NOT leaf").groupBy("host", "path").agg(F.count("*").alias("m"))
    # all paragraphs of a big host are contents of one node: they meet its page count in parts
    m = pages.withColumn("leaf", F.lit(True)).unionByName(branch.withColumn("leaf", F.lit(False))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    share = F.when(F.col("m") > 1, F.log("n") / F.log("m")).otherwise(F.lit(0.0))
    parts = parts.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(m, ["host", "path", "leaf", "salt"]).drop("salt").withColumn("importance", F.greatest(F.lit(0.0), F.when(F.col("leaf"), 1 - share)))
    parts = cut(parts, "styles")
    p = F.col("n") / F.col("m")
    nodes = parts.groupBy("host", "path", "leaf").agg(
        F.max("m").alias("pages"),
        F.count("*").alias("styles"),
        (F.sum(F.col("n") * F.col("importance")) / F.sum("n")).alias("content"),
        F.when(F.max("m") > 1, F.greatest(F.lit(0.0), -F.sum(p * F.log(p)) / F.log(F.max("m")))).otherwise(F.lit(1.0)).alias("entropy"),
    )
    weight = F.greatest(F.pow(F.lit(GAMMA), F.col("styles")), F.lit(1e-30))
    nodes = cut(nodes.withColumn("own", F.when(F.col("leaf"), F.col("content")).otherwise((1 - weight) * F.col("entropy"))), "nodes")
    kids = nodes.groupBy("host", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("up")).agg(F.count("*").alias("kids"))
    factor = nodes.where("NOT leaf").select("host", F.col("path").alias("up"), F.log(weight).alias("w")).join(kids, ["host", "up"]).select("host", "up", (F.col("w") - F.log("kids")).alias("w"))
    over = Window.partitionBy("host", "path", "leaf").orderBy("far")  # as many rows as the branch is deep
    adds = _ancestors(nodes.select("host", "path", "leaf", "own")).join(factor, ["host", "up"]).withColumn("adds", F.col("own") * F.exp(F.sum("w").over(over)))
    below = adds.groupBy("host", F.col("up").alias("path")).agg(F.sum("adds").alias("below")).withColumn("leaf", F.lit(False))
    nodes = nodes.join(below, ["host", "path", "leaf"], "left").select("host", "path", "leaf", "pages", "styles", (F.col("own") + F.coalesce("below", F.lit(0.0))).alias("importance"))
    return nodes, parts


def low_branches(nodes: DataFrame, threshold: float = BRANCH) -> DataFrame:
    """(host, path) of the leaves below branches that matter as little as all that is below them: on more than one page, and of a
    composite importance under the threshold throughout."""
    low = (F.col("importance") < threshold) & (F.col("pages") > 1)
    kept = _ancestors(nodes.where(~low).select("host", "path", "leaf")).select("host", F.col("up").alias("path")).distinct()
    noisy = nodes.where(low & ~F.col("leaf")).select("host", "path").join(kept, ["host", "path"], "left_anti")
    leaves = _ancestors(nodes.where("leaf").select("host", "path", "leaf"))
    return leaves.join(noisy.select("host", F.col("path").alias("up")), ["host", "up"], "left_semi").select("host", "path").distinct()


def prune_sites(documents: DataFrame, key: str = "doc_id", text: str = "content_text", host: str = "source", threshold: float = THRESHOLD, branch_threshold: float = BRANCH) -> DataFrame:
    """(doc_id, n_blocks, n_removed, clean_text) of every row: clean text without the branches that its host's pages share, whatever
    stands in them on this page, and without single contents that they share.

    Hosts are compared trimmed in lower case, rows without one are a host of their own kind (''). Null texts have no blocks and
    null clean text. keys should be unique; repeated ones lose the blocks of either.
    """
    docs = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(norm_key(F.col(host)), F.lit("")).alias("host"), F.col(text).alias("text"))
    pages = cut(parsed_pages(docs), "pages")
    feats = features_of(pages)
    nodes, parts = style_tree(feats)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    low = parts.where(F.col("leaf") & (F.col("importance") < threshold) & (F.col("n") > 1)).select("host", "path", "h", salts)
    leaves = feats.where("leaf AND key IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    shared = leaves.join(low, ["host", "path", "h", "salt"], "left_semi")
    noisy = leaves.join(low_branches(nodes, branch_threshold).select("host", "path", salts), ["host", "path", "salt"], "left_semi")
    gone = shared.unionByName(noisy).groupBy("key").agg(F.collect_set(F.struct("path", "h")).alias("gone"))  # bounded by the blocks of one page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out, removed = [], [], []
            for blocks, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if blocks is None:
                    n.append(0), removed.append(0), out.append(None)
                    continue
                bad = {(x["path"], x["h"]) for x in g or ()}
                keep = [markup.Block(x["kind"], x["level"], x["text"], x["path"]) for x in blocks if (x["path"], x["h"]) not in bad]
                n.append(len(blocks)), removed.append(len(blocks) - len(keep)), out.append(markup.render(keep))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(removed, pa.int32()), pa.array(out, pa.string())], names=[key, "n_blocks", "n_removed", "clean_text"])

    return pages.select("key", "blocks").join(gone, "key", "left").select("key", "blocks", "gone").mapInArrow(run, f"{key} long, n_blocks int, n_removed int, clean_text string")
