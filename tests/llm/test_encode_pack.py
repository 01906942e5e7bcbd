import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import encode, lexicon, pack


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=6), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
def test_lexicon_finds_exactly_its_words(tmp_path_factory, words, others):
    d = {w: [len(w), i] for i, w in enumerate(words)}
    p = str(tmp_path_factory.mktemp("lex") / "x.bin")
    lexicon.save(lexicon.build(d), p)
    lex = lexicon.Lexicon(p)
    ask = [*words, *others]
    for w, r in zip(ask, lex.ranks(ask).tolist()):
        assert (r >= 0) == (w in d)
        if r >= 0:
            assert lex.ids_of(r).tolist() == d[w]


def test_lexicon_is_minimal():
    a = lexicon.build({w: [1] for w in (b"tops", b"taps", b"top", b"tap", b"stop")})
    assert len(a["final"]) == 8 and a["ids"].tolist() == [1] * 5


TEXTS = [
    None, "", " ", "plain words", "It's WE'RE don't I'LL", "<|endoftext|> stays text <pad>", "naïve café 한국어 文字 🙂🙂 \u200b", "a\u00a0b\ttab\r\n\n  indented   end  ", "x" * 5000, "12345678901234567890 3.14", "ﬁ ½ ²",
    "word " * 3000, "\n" * 100, "'s't're", "данные готовы",
]


def expected(t):
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    k.encode_special_tokens = True
    return k.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "no key", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    for most in (60_000, 3, 0):
        got = encode.encode_corpus(df, max_words=most).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["ids"] == expected("no key" if r["doc_id"] is None else TEXTS[r["doc_id"]])
    n = {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df).collect()}
    assert n[0] == n[1] == 0 and n[3] == 2
    assert encode.encode_corpus(df.limit(0)).count() == 0


def test_memory_of_words_is_forgotten(spark, monkeypatch):
    monkeypatch.setattr(encode, "CACHE", 5)
    e = encode.Encoder(type("L", (), {"ranks": lambda self, w: np.full(len(w), -1)})(), encode.TOKENIZERS)
    for _ in range(3):
        ids, n = e.encode(["one two three four five six seven", None, "", "eight nine"])
        assert n.tolist()[1:3] == [0, 0] and ids[: n[0]].tolist() == expected("one two three four five six seven")


def test_a_shard_is_packed_well():
    r = random.Random(1)
    size = np.array([min(2048, 1 + int(r.lognormvariate(5.5, 1))) for _ in range(4000)])
    c, tier = pack.pack_shard(size, 2048, (256, 512, 1024))
    fill = np.bincount(c, size)
    assert fill.max() <= 2048 and fill.sum() == size.sum() and len(fill) == len(tier) and size.sum() / (2048 * len(fill)) > 0.99
    g = pack.step_groups(fill, 32)
    assert np.bincount(g).max() <= 32 and np.ptp(np.bincount(g, fill)[np.bincount(g) == 32]) <= 2048


def test_items_are_whole_or_longer_than_a_container(spark):
    rows = [(1, 0), (2, None), (3, 5000), (4, 2048), (5, 2049), (6, 10), (6, 10), (None, 3), *[(100 + k, 1 + k % 700) for k in range(500)]]
    df = spark.createDataFrame(rows, "key long, n_tokens long").withColumn("shard", F.lit("clash"))
    got = pack.pack_items(df, shard_tokens=20_000).collect()
    total = sum(n or 0 for _, n in rows)
    assert sum(r["n_tokens"] for r in got) == total
    by = {}
    for r in got:
        if r["container_id"] is not None:
            by[r["container_id"]] = by.get(r["container_id"], 0) + r["n_tokens"]
    assert max(by.values()) <= 2048 and total / (2048 * len(by)) > 0.9
    pieces = sorted((r["piece_no"], r["start_at"], r["n_tokens"]) for r in got if r["key"] == 3)
    assert pieces == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert [r["container_id"] for r in got if r["key"] in (1, 2)] == [None, None] and sum(r["key"] == 6 for r in got) == 2
    assert all(r["piece_no"] == 0 for r in got if r["key"] not in (3, 5))
    assert pack.pack_items(df.limit(0)).count() == 0
    rep = pack.fill_report(spark.createDataFrame(got, pack.PACKED)).collect()
    assert sum(r["n_tokens"] for r in rep) == total


def test_windows_are_of_four_sizes_and_full():
    """Plain best fit has windows of one size only. Every tier is packed into its own, all are full, long gaps hold short items."""
    r = random.Random(2)
    size = np.array([min(2048, 1 + int(r.lognormvariate(5.3, 0.9))) for _ in range(9000)])
    w, tier, container = pack.pack_windows(size)
    fill = np.bincount(w, size)
    assert len(fill) == len(tier) == len(container) and (fill <= tier).all() and fill.sum() == size.sum()
    for t in (256, 512, 1024, 2048):
        assert (tier == t).sum() > 20 and fill[tier == t].sum() / tier[tier == t].sum() > 0.99
    total = np.bincount(container, tier)
    assert total.max() == 2048 and (total < 2048).sum() <= 1  # windows make up whole containers
    assert size.sum() / (2048 * len(total)) > 0.99
    for t in (512, 1024):  # an item of the tier, and shorter ones in its gap
        own = [(x > t // 2).sum() for x in (size[w == k] for k in np.flatnonzero(tier == t)[:200])]
        assert set(own) == {1}
    assert all(len(x) == 0 for x in pack.pack_windows(np.zeros(0, np.int64)))


def test_windows_of_odd_sizes():
    """Tiers and a capacity that are no multiples of each other: nothing is lost, no window and no container overflows."""
    r = random.Random(8)
    for capacity, tiers in ((1000, (300, 450)), (7, ()), (100, (99,))):
        size = np.array([r.randrange(1, capacity + 1) for _ in range(400)])
        w, tier, container = pack.pack_windows(size, capacity, tiers)
        assert (np.bincount(w, size) <= tier).all() and np.bincount(container, tier).max() <= capacity and len(w) == 400


def test_step_groups_are_of_one_tier(spark):
    df = spark.createDataFrame([(k, 1 + (k * 37) % 900) for k in range(3000)], "key long, n_tokens long")
    got = pack.pack_items(df).collect()
    longest, steps = {}, {}
    for x in got:
        longest[x["container_id"]] = max(longest.get(x["container_id"], 0), x["tier"])
        steps.setdefault(x["step_group"], set()).add(x["container_id"])
    assert all(len({longest[c] for c in cs}) == 1 and len(cs) <= pack.GROUP for cs in steps.values())
    assert len({x["tier"] for x in got}) > 2 and {x["n_tokens"] <= x["tier"] for x in got} == {True}
