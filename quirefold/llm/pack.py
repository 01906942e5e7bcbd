"""Filling fixed-capacity containers with items (problem 9).

Method: hierarchical multi-length packing. Items are routed to the tier of the shortest window that takes them (256, 512, 1024 or
2048 tokens). From the longest tier down, each item opens a window of its tier and the gap is filled from shorter tiers, best
to the last token; the shortest tier is packed among itself. A window that can't be filled this way within SLACK is dissolved, and
what is left over so is packed into windows of the longest tier. Containers have one fixed capacity: windows of one tier (two of
1024, four of 512, eight of 256) make a container up, and containers of one tier are dealt into step groups of about equal
tokens. The items are dealt at random, by hash, into shards of a fixed number of tokens that pack independently: a shard is
large against a container, so what its last containers leave open is a small and constant share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import cut

CAPACITY = 2048
#: Window sizes of the shorter tiers; the longest is the capacity.
TIERS = (256, 512, 1024)
#: Share of a window that may stay open.
SLACK = 0.01
#: Tokens of one shard: some thousand containers.
SHARD_TOKENS = 4 << 20
#: Containers of a step group.
GROUP = 32

PACKED = "key long, piece_no int, start_at long, n_tokens long, container_id long, window_id long, tier int, step_group long"


class _Stock:
    """Items by size; sets of sizes are bits of a whole number, so what fits a gap is found without a search."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in np.argsort(-sizes, kind="stable")[::-1].tolist():
            self.items[int(sizes[i])].append(i)
        self.have = self.back = 0  # bit n is set where an item of n is there; back is the same from the other end
        for n, x in enumerate(self.items):
            if n and x:
                self.have |= 1 << n
                self.back |= 1 << (capacity - n)

    def take(self, n: int) -> int:
        i = self.items[n].pop()
        if not self.items[n]:
            self.have &= ~(1 << n)
            self.back &= ~(1 << (self.capacity - n))
        return i

    def give(self, n: int, i: int) -> None:
        self.items[n].append(i)
        self.have |= 1 << n
        self.back |= 1 << (self.capacity - n)

    def largest(self, most: int) -> int:
        return (self.have & ((1 << (most + 1)) - 1)).bit_length() - 1

    def fill(self, gap: int) -> list[tuple[int, int]]:
        """(size, item) of items for a gap: one or two that close it, else the largest and what then fits."""
        out = []
        while gap > 0:
            if self.have >> gap & 1:
                return [*out, (gap, self.take(gap))]
            pair = self.have & (self.back >> (self.capacity - gap))
            while pair:
                a = pair.bit_length() - 1
                if 2 * a != gap or len(self.items[a]) > 1:
                    return [*out, (a, self.take(a)), (gap - a, self.take(gap - a))]
                pair &= ~(1 << a)
            n = self.largest(gap)
            if n <= 0:
                break
            out.append((n, self.take(n)))
            gap -= n
        return out


def pack_windows(sizes: np.ndarray, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The window of each item of 1 to capacity tokens, the size of each window, and the container of each window."""
    stock = _Stock(sizes, capacity)
    edges = [*tiers, capacity]
    windows: list[tuple[int, list[int]]] = []
    loose: list[tuple[int, int]] = []
    for k in range(len(edges) - 1, -1, -1):
        size, below = edges[k], edges[k - 1] if k else 0
        while (n := stock.largest(size)) > below:
            own = (n, stock.take(n))
            more = stock.fill(size - n)
            if size - n - sum(m for m, _ in more) <= slack * size:
                windows.append((size, [own[1], *(i for _, i in more)]))
            else:  # dissolved: the gap's items stay in stock for others
                loose.append(own)
                for m, i in more:
                    stock.give(m, i)
    container, room = [], 0
    for size, _ in windows:  # longest first, so they make up whole containers
        if size > room:
            container.append((container[-1] + 1) if container else 0)
            room = capacity - size
        else:
            container.append(container[-1])
            room -= size
    # what is left over: first into windows that complete the last container, then into windows of the longest tier
    rest = _Stock(np.array([n for n, _ in loose], np.int64), capacity)
    ids = [i for _, i in loose]
    while rest.have:
        size = capacity
        if room and windows:
            size = max((e for e in edges if e <= room), default=0)
            if not size or not rest.largest(size) > 0:
                room = 0
                continue
            container.append(container[-1])
            room -= size
        else:
            container.append(container[-1] + 1 if container else 0)
        n = rest.largest(size)
        got = [rest.take(n), *(i for _, i in rest.fill(size - n))]
        windows.append((size, [ids[i] for i in got]))
    out = np.zeros(len(sizes), np.int64)
    for w, (_, items) in enumerate(windows):
        out[items] = w
    return out, np.array([s for s, _ in windows], np.int64), np.array(container, np.int64)


def pack_shard(sizes: np.ndarray, capacity: int, tiers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, and the longest window of each container."""
    window, size, container = pack_windows(sizes, capacity, tiers)
    tier = np.zeros(container.max() + 1 if len(container) else 0, np.int64)
    np.maximum.at(tier, container, size)
    return container[window], tier


def step_groups(fill: np.ndarray, group: int) -> np.ndarray:
    """A group for each container: they are dealt fullest first, forth and back, so groups come out about equal."""
    n = -(-len(fill) // group)
    order = np.argsort(-fill, kind="stable")
    turn, at = np.divmod(np.arange(len(fill)), n)
    out = np.zeros(len(fill), np.int64)
    out[order] = np.where(turn % 2 == 0, at, n - 1 - at)
    return out


def pack_items(items: DataFrame, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, shard_tokens: int = SHARD_TOKENS, group: int = GROUP) -> DataFrame:
    """(key, piece_no, start_at, n_tokens, container_id, window_id, tier, step_group) of items (key, n_tokens); tier is the size of
    the item's window.

    An item longer than a container is cut into whole containers and a rest; no other item is cut. Items without tokens (null
    counts too) need no room: one row, container null. Repeated rows are items of their own. An empty table gives no rows.
    """
    items = cut(items.select(F.col("key").cast("long").alias("key"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")))
    parts = items.withColumn("piece_no", piece).withColumn("start_at", F.col("piece_no") * F.lit(capacity).cast("long")).withColumn("n_tokens", F.least(F.col("n") - F.col("start_at"), F.lit(capacity)))
    empty = parts.where("n = 0").select("key", "piece_no", "start_at", "n_tokens", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("window_id"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("long").alias("step_group"))
    # dealt by key, piece and a number within the task, so that a third of all rows with one key spreads as well
    shard = F.pmod(F.xxhash64("key", "piece_no", F.monotonically_increasing_id()), F.lit(shards))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "piece_no"], ascending=[False, True, True], kind="stable")
        size = pdf["n_tokens"].to_numpy()
        w, window_size, container = pack_windows(size, capacity, tiers)
        c = container[w]
        fill = np.bincount(c, size)
        longest = np.zeros(len(fill), np.int64)
        np.maximum.at(longest, container, window_size)
        steps, first = np.zeros(len(fill), np.int64), 0
        for t in np.unique(longest):  # a step's containers are of one tier
            of = longest == t
            steps[of] = first + step_groups(fill[of], group)
            first = int(steps[of].max()) + 1
        base = int(pdf["shard"].iloc[0]) << 32
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "piece_no": pdf["piece_no"].to_numpy(), "start_at": pdf["start_at"].to_numpy(), "n_tokens": size, "container_id": base + c, "window_id": base + w, "tier": window_size[w].astype(np.int32), "step_group": base + steps[c]})

    packed = parts.where("n > 0").select("key", "piece_no", "start_at", "n_tokens", shard.alias("shard")).groupBy("shard").applyInPandas(run, PACKED)
    return packed.unionByName(empty)


def fill_report(packed: DataFrame) -> DataFrame:
    """(tier, n_windows, n_pieces, n_tokens, fill) of all windows, by their size."""
    per = packed.where("window_id IS NOT NULL").groupBy("window_id", "tier").agg(F.count("*").alias("p"), F.sum("n_tokens").alias("t"))
    return per.groupBy("tier").agg(F.count("*").alias("n_windows"), F.sum("p").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.round(F.sum("t") / (F.count("*") * F.col("tier")), 4).alias("fill"))
